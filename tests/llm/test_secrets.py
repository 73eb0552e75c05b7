import random
import re

import pytest

from gridloom.llm import secrets

NAME = b"|".join(b"".join(b"[%c%c]" % (c, c - 32) if 97 <= c <= 122 else b"%c?" % c for c in w) for w in (b"password", b"passwd", b"secret", b"token", b"api_key"))
ASSIGN = re.compile(rb"(?:" + NAME + rb")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
OTHERS = [rb"AKIA[A-Z0-9]{12,}", rb"[0-9a-f]{32,}", rb"gh[pousr]_[A-Za-z0-9]{36,}", rb"xox[abprs]-[A-Za-z0-9-]{20,}", rb"eyJ[A-Za-z0-9_.-]{40,}", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----+"]
#: A too short match is passed over as a whole, so each pattern is searched with + and its length checked.
LOOSE = [re.sub(rb"\{\d+,\}", b"+", p) for p in OTHERS]
BITS = [b"token", b"secret", b"password", b"passwd", b"api", b"_", b"key", b"KEY", b"=", b":", b" ", b"'", b'"', b"a", b"f", b"0123456789abcdef", b"AKIA", b"Z9", b"ABCDEFGH12345678", b"\n", b"tok", "é€".encode(), b"-", b".", b"ghp_", b"eyJ", b"xoxb-", b"-----BEGIN RSA ", b"PRIVATE KEY-----"]


def brute(d: bytes):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(d) if len(m[1]) >= 8]
    for r, (loose, strict) in enumerate(zip(LOOSE, OTHERS), 1):
        out += [(m.start(), m.end(), r) for m in re.finditer(loose, d) if re.fullmatch(strict, m[0])]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_automaton_against_regular_expressions():
    rnd, auto = random.Random(7), secrets.automaton()
    for _ in range(20_000):
        d = b"".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 40)))
        assert auto.spans(d) == brute(d), d


def test_minimal_automaton_is_smaller():
    auto = secrets.automaton(secrets.BASE)
    assert len({(tuple(r), m) for r, m in zip(auto.transitions, auto.marks)}) == len(auto.transitions)


def test_undecidable_rule_is_refused():
    rule = secrets.Rule("x", secrets.alt(secrets.word("abcd"), secrets.word("b")), frozenset(b"c"), 1)
    with pytest.raises(ValueError):
        secrets.Automaton((rule,))


def test_scan_and_redact(spark):
    long = "é" * 100_000 + " password = 'abcdefgh1' x"
    rows = [(1, "token: abc"), (2, long), (3, None), (4, ""), (None, "AKIA" + "A" * 16), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "'k' as kind")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}
    assert got[2]["spans"] == f"assign:100001:100022" and got[2]["n_assign"] == 1
    assert got[None]["spans"] == "access:0:20" and got[3]["spans"] == "" and got[1]["n_assign"] == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[1] == "token: abc" and clean[2].endswith("é [SECRET]' x") and clean[3] is None
    assert secrets.scan(df.limit(0)).count() == 0
