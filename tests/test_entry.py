import importlib
import sys

import __spark_entry__


def test_entry_without_the_text_operators(monkeypatch):
    """The entry module still gives the library's own queries once the text subpackage and the pipeline are gone."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "gridloom.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("gridloom.llm") or k == "corpus_pipeline"}
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    names = set(importlib.reload(__spark_entry__).queries())
    monkeypatch.undo()
    sys.modules.update(kept)
    importlib.reload(__spark_entry__)
    assert "x02_best_n1" in names and not any(n.startswith("op") for n in names)
