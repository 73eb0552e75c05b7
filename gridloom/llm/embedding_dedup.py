"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

1. Equal vectors are one class; only a class goes on, with the number of its rows.
2. A vector is padded to a power of two and turned by three rounds of random signs and a Hadamard transform; the axis nearest
   to it, one of twice the length, is a hash. Three hashes are a bucket of one of seven tables. Each vector has a home in
   every table and visits the seven buckets that it misses by least. A pair at the threshold fails to meet, home against
   home or visit, once in some 10,000 times.
3. Buckets are met by key alone; vectors are sent only to buckets where another one is. A bucket of more than CELL vectors is
   cut into cells, each of two parts of it, so that no task holds more than a cell.
4. In a cell all pairs with a home in it are compared in double precision by matrix products. A pair that meets in several
   buckets counts in the first one, which both vectors' keys tell; so links are counted where they are found, and a cell
   gives one count for a vector and a forest of links, however many pairs are linked.
5. Links are grouped by union-find and star steps.

Defined results. A vector that is null, empty, zero or holds null or non-finite components links with nothing, equal ones
not either; so do vectors of different lengths. A null id: component_id is the smallest id reachable, null if there is none,
kept is false. Rows that repeat an id are vectors of their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import scope, stored
from gridloom.llm.components import components

TABLES, HASHES, PROBES = 7, 3, 8
#: Axes of a hash that probes use, and vectors in half a cell.
AXES, CELL = 6, 1024
#: Groups up to this size are compared together; pairs that are looked up at once.
SMALL, PAIRS = 64, 1 << 15
_SEED = 20_240_611
#: Choices of an axis for each hash, the nearest being 0, among which the cheapest PROBES are taken.
_CHOICES = np.array([c for c in itertools.product(range(AXES), repeat=HASHES) if np.prod(np.array(c) + 1) <= 2 * PROBES])


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, not scaled."""
    n, h = x.shape[1], 1
    while h < n:
        halves = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate((halves[:, :, :1] + halves[:, :, 1:], halves[:, :, :1] - halves[:, :, 1:]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; none of them is zero."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def buckets(rows: np.ndarray) -> np.ndarray:
    """For each unit vector and table the home bucket and those it visits, cheapest first."""
    d = 1 << max(1, (rows.shape[1] - 1).bit_length())
    x = np.zeros((len(rows), d))
    x[:, : rows.shape[1]] = rows
    signs = np.random.default_rng(_SEED + d).choice((-1.0, 1.0), size=(TABLES, HASHES, 3, d))
    out, axes = np.empty((len(x), TABLES, PROBES), np.int64), min(AXES, 2 * d)
    choices = _CHOICES[(_CHOICES < axes).all(axis=1)]
    for t in range(TABLES):
        key, cost = np.zeros((len(x), len(choices)), np.int64), np.zeros((len(x), len(choices)))
        for k in range(HASHES):
            y = x
            for s in signs[t, k]:
                y = _hadamard(y * s) / np.sqrt(d)
            both = np.concatenate((y, -y), axis=1)
            near = np.argpartition(-both, axes - 1, axis=1)[:, :axes]
            value = np.take_along_axis(both, near, axis=1)
            order = np.lexsort((near, -value), axis=1)
            near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
            key = key * (2 * d) + near[:, choices[:, k]]
            cost += ((value[:, :1] - value) ** 2)[:, choices[:, k]]
        first = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        out[:, t] = np.take_along_axis(key, first, axis=1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, dim, place (table), bucket and home for vectors (node, vector), whatever their lengths."""
    for b in batches:
        node, size = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()
        for d in np.unique(size):
            mine = np.flatnonzero(size == d)
            for at in range(0, len(mine), 2048):
                some = mine[at : at + 2048]
                got = buckets(unit(_matrix(b.column(1).take(pa.array(some)))))
                n = len(some)
                home = np.zeros((n, TABLES, PROBES), bool)
                home[:, :, 0] = True
                place = np.broadcast_to(np.arange(TABLES)[None, :, None], got.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[some], TABLES * PROBES)), pa.array(np.full(got.size, d, np.int32)), pa.array(place.ravel().astype(np.int32)), pa.array(got.ravel()), pa.array(home.ravel())], ["node", "dim", "place", "bucket", "home"])


def _first_meeting(x: np.ndarray, y: np.ndarray, table: int, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs of vectors with buckets x and y, the one with the smaller number first, meet in table's bucket first."""
    first = np.ones(len(x), bool)
    for t in range(table):
        first &= ~((x[:, t, :1] == y[:, t]).any(axis=1) | (y[:, t, :1] == x[:, t]).any(axis=1))
    there = (x[:, table, :1] == y[:, table]).any(axis=1)
    return first & (bucket == np.where(there, x[:, table, 0], y[:, table, 0]))


class _Tally:
    """Counts of links and a forest of them, of the pairs of a part of the rows."""

    def __init__(self):
        self.links: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray) -> None:
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate((rows_b, rows_a)))
        for n, t in zip(nodes.tolist(), total.tolist(), strict=True):
            self.links[n] = self.links.get(n, 0) + int(t)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def taken(self) -> pa.RecordBatch:
        """What was added, as rows (node, other, n): a count where other is null, else a link."""
        forest = [(x, self.root(x)) for x in self.parent if self.root(x) != x]
        node = [*self.links, *(x for x, _ in forest)]
        other = [*[None] * len(self.links), *(y for _, y in forest)]
        n = [*self.links.values(), *[0] * len(forest)]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64())], ["node", "other", "n"])


def _compared(percent: int):
    least = percent / 100

    def counted(rows: dict[str, np.ndarray], keys: np.ndarray, low: int, i: np.ndarray, j: np.ndarray, tally: _Tally) -> None:
        """Adds the linked pairs (i, j) of rows that meet first in their bucket; keys has the buckets of rows from low on."""
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            swap = rows["node"][a] > rows["node"][b]
            x, y, good = keys[np.where(swap, b, a) - low], keys[np.where(swap, a, b) - low], np.zeros(len(a), bool)
            for t in np.unique(rows["place"][a]):
                mine = rows["place"][a] == t
                good[mine] = _first_meeting(x[mine], y[mine], int(t), rows["bucket"][a][mine])
            a, b = a[good], b[good]
            if len(a):
                tally.add(rows["node"][a], rows["node"][b], rows["rows"][a], rows["rows"][b])

    def dense(rows: dict[str, np.ndarray], v: np.ndarray, low: int, high: int, tally: _Tally) -> None:
        """One large group, or a cell: its homes on the left with homes and visits on the right."""
        side, home, node = (rows[k][low:high] for k in ("side", "home", "node"))
        left, right, keys = np.flatnonzero((side != 2) & home), np.flatnonzero(side != 1), None
        twice = home[right] & (rows["part"][low] == rows["mate"][low])  # such pairs are seen from both ends
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            p, q = np.nonzero(v[low + a] @ v[low + right].T >= least)
            i, j = node[a[p]], node[right[q]]
            once = np.where(twice[q], i < j, i != j)
            if once.any():
                keys = buckets(v[low:high]) if keys is None else keys
                counted(rows, keys, low, low + a[p[once]], low + right[q[once]], tally)

    def of_rows(rows: dict[str, np.ndarray], v: np.ndarray, tally: _Tally) -> None:
        """Rows sorted by group, whole groups; small groups are compared together, by the distance of their rows."""
        fresh = np.ones(len(v) + 1, bool)
        fresh[1:-1] = False
        for k in ("place", "bucket", "part", "mate"):
            fresh[1:-1] |= rows[k][1:] != rows[k][:-1]
        starts = np.flatnonzero(fresh)
        size = np.diff(starts)
        large = (size > SMALL) | (np.maximum.reduceat(rows["side"], starts[:-1]) > 0)
        for a, z in zip(starts[:-1][large], starts[1:][large], strict=True):
            dense(rows, v, int(a), int(z), tally)
        group, found = np.repeat(np.where(large, -1, np.arange(len(size))), size), [np.empty((2, 0), int)]
        for k in range(1, int(size[~large].max(initial=1))):
            i = np.flatnonzero((group[:-k] == group[k:]) & (group[:-k] >= 0))
            i = i[rows["home"][i] | rows["home"][i + k]]
            i = i[np.einsum("ij,ij->i", v[i], v[i + k]) >= least]
            found.append(np.stack((i, i + k)))
        i, j = np.concatenate(found, axis=1)
        if len(i):
            used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            some = {k: c[used] for k, c in rows.items()}
            counted(some, buckets(v[used]), 0, at[: len(i)], at[len(i) :], tally)

    names = ["node", "dim", "place", "bucket", "home", "part", "mate", "side", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tally = _Tally()

        def closed(b: pa.RecordBatch) -> None:
            dims = b.column("dim").to_numpy()
            cut = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for a, z in itertools.pairwise(cut):
                part = b.slice(a, z - a)
                rows = {k: part.column(k).to_numpy(zero_copy_only=False) for k in names}
                of_rows(rows, unit(_matrix(part.column("vector"))), tally)

        def same(b: pa.RecordBatch, i: int, c: pa.RecordBatch, j: int) -> bool:
            return all(b.column(k)[i] == c.column(k)[j] for k in ("dim", "place", "bucket", "part", "mate"))

        for b in batches:
            if not b.num_rows:
                continue
            if held and not same(held[-1], held[-1].num_rows - 1, b, 0):
                closed(pa.concat_batches(held))
                held = []
            at = b.num_rows
            if not same(b, 0, b, at - 1):  # the last group may go on in the next batch
                last, low = at - 1, 0
                while last - low > 1:
                    mid = (low + last) // 2
                    low, last = (low, mid) if same(b, mid, b, at - 1) else (mid, last)
                closed(pa.concat_batches([*held, b.slice(0, last)]))
                held = [b.slice(last)]
            else:
                held.append(b)
            if len(tally.links) > 100_000 or len(tally.parent) > 100_000:
                yield tally.taken()
        if held:
            closed(pa.concat_batches(held))
        yield tally.taken()

    return run


def _valid(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def linked(classes: DataFrame, percent: int) -> DataFrame:
    """node, other and n: how often a class (node, vector, rows) is linked where other is null, else a link that joins."""
    keys = stored(classes.select("node", "vector").mapInArrow(_keyed, "node long, dim int, place int, bucket long, home boolean"), "embed-keys")
    met = keys.groupBy("dim", "place", "bucket").agg(F.count(F.lit(1)).alias("met"), F.count_if("home").alias("homes")).where("met > 1 and homes > 0")
    met = stored(met.selectExpr("dim", "place", "bucket", f"cast(ceil(met / {CELL}) as int) as parts"), "embed-met")
    rows = stored(keys.join(met, ["dim", "place", "bucket"]), "embed-rows").join(classes, "node")
    mine = F.pmod(F.xxhash64("node", "place"), F.col("parts")).cast("int")
    one = rows.where("parts = 1").withColumns({"part": F.lit(0), "mate": F.lit(0), "side": F.lit(0)})
    cut = rows.where("parts > 1").withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # A cell has the homes of one part on its left; on its right the visits of another, and its homes too if it is a later one.
    left = cut.where("home").selectExpr("*", "mine as part", "with as mate", "if(mine = with, 0, 1) as side")
    right = cut.where("(not home) or with < mine").selectExpr("*", "with as part", "mine as mate", "2 as side")
    columns = ["node", "dim", "place", "bucket", "home", "part", "mate", "side", "rows", "vector"]
    cells = one.select(*columns).unionByName(left.select(*columns)).unionByName(right.select(*columns))
    group = ["dim", "place", "bucket", "part", "mate"]
    return cells.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compared(percent), "node long, other long, n long")


def near_vectors(table: DataFrame, percent: int = 95) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of table (vec_id, embedding): links at a cosine of percent / 100 or more."""
    with scope("embed-groups") as result:
        rows = table.select("vec_id", F.col("embedding").alias("vector"))
        whole = rows.select("vec_id", "vector", F.when(_valid(F.col("vector")), F.sha2(F.to_json(F.struct("vector")), 256)).alias("same"))
        rows = stored(whole, "embed-whole")
        classes = rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("vector").alias("vector"))
        classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "embed-classes")
        found = stored(linked(classes.select("node", "vector", "rows"), percent), "embed-links")
        counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
        roots = stored(components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))), "embed-roots").withColumnRenamed("node", "of")
        placed = classes.select("node", "same", "rep", "rows").join(counts, "node", "left").join(roots, F.col("node") == F.col("of"), "left")
        placed = stored(placed.select("same", "rep", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "embed-placed")
        least = stored(placed.groupBy("root").agg(F.min("rep").alias("least")), "embed-least")
        told = stored(placed.join(least, "root").select(F.col("same").alias("key"), "n_links", "least"), "embed-told")
        out = rows.select("vec_id", "same").join(told, F.col("same") == F.col("key"), "left")
        component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("least"))
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"))
        return result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
