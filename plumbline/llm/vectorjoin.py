"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine is at least a threshold lie within epsilon of each other, so do their projections on any
orthonormal axes. Vectors are sorted by label and by their grid cells on the leading principal axes, cells being
epsilon wide, and cut into blocks of consecutive ones. A tree over the sequence of blocks holds the extent of every
interval; it is descended from the root by pairs of intervals, and pairs that lie over epsilon apart end there. Pairs
of blocks that remain are joined in tasks, by halves again, down to leaves whose cosines are computed.

Equal vectors are one class with a count, so copies are never compared. A task returns counts of links and a
forest of them, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, join_uneven, written
from plumbline.llm.components import connected_components

#: Leading principal axes of the grid; vectors of a block and of a leaf; intervals of one above; vectors of a sorted range.
AXES, BLOCK, LEAF, FAN, RANGE = 16, 1024, 128, 16, 16 * 1024
#: Axes are fitted for this many lengths of vectors, up to this length; others take their leading components for axes.
LENGTHS, LONGEST = 4, 2048
#: What sums of doubles may be off by; distances are taken this much shorter, cosines this near the threshold are computed again.
OFF = 1e-9


def usable() -> Column:
    """Whether a row has a label and a vector of finite components, not all of them 0."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1, so that no square overflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def units(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in doubles."""
    rows = scaled(rows)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows' places, their values) of the vectors of a column, by length."""
    ends = column.offsets.to_numpy()
    values, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, values[ends[at][:, None] + np.arange(d)]


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """The leading principal axes, a column each, of the most frequent lengths; over all vectors, d rows of sums on the driver."""
    lengths = [r["d"] for r in classes.groupBy(F.size("embedding").alias("d")).count().where(F.col("d") <= LONGEST).orderBy(F.col("count").desc(), "d").limit(LENGTHS).collect()]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, rows in _by_length(batch.column(0)):
                if d in lengths:
                    u = np.hstack([units(rows.astype(np.float64)), np.ones((len(rows), 1))])
                    held[d] = held.get(d, 0) + u.T @ u
        rows = [(d, i, own[i].tobytes()) for d, own in held.items() for i in range(d + 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["d", "i", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in rows["sums"])
        return rows.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))

    schema = "d int, i int, sums binary"
    found = classes.select("embedding").mapInArrow(sums, schema).groupBy("d", "i").applyInArrow(added, schema)
    rows: dict[int, dict[int, np.ndarray]] = {}
    for r in found.collect():
        rows.setdefault(r["d"], {})[r["i"]] = np.frombuffer(r["sums"])
    axes = {}
    for d, own in rows.items():
        whole = np.stack([own[i] for i in range(d + 1)])
        n, mean = whole[d, d], whole[d, :d] / whole[d, d]
        axes[d] = np.linalg.eigh(whole[:d, :d] / n - np.outer(mean, mean))[1][:, ::-1][:, :AXES].copy()
    return axes


def _projected(axes: dict[int, np.ndarray], u: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, AXES columns; missing ones are 0."""
    d = u.shape[1]
    p = u @ axes[d] if d in axes else u[:, :AXES]
    return p if p.shape[1] == AXES else np.hstack([p, np.zeros((len(p), AXES - p.shape[1]))])


def grid_keys(classes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """classes with their length d and cell: the grid cells as bytes that sort as the cells do, and the vector as bytes."""
    double = "double" in dict(classes.dtypes)["embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, rows in _by_length(batch.column(0)):
                cells = np.floor(_projected(axes, units(rows.astype(np.float64))) / width).astype(np.int64) + (1 << 31)
                keys = cells.astype(">u4")
                rows = np.ascontiguousarray(rows.astype(np.float64 if double else np.float32))
                columns = [pa.array(np.full(len(at), d, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(at)) for i in range(1, 6)] + columns, ["label", "k1", "k2", "least", "n", "d", "cell", "raw"])

    kinds = dict(classes.dtypes)
    listed = classes.select("embedding", F.col("label").cast("string").alias("label"), "k1", "k2", "least", "n")
    return listed.mapInArrow(run, f"label string, k1 long, k2 long, least {kinds['least']}, n long, d int, cell binary, raw binary")


_BLOCKS = "part int, place int, label string, d int, rows int, low array<double>, high array<double>, k1 array<long>, k2 array<long>, least array<long>, n array<long>, raw binary"


def _cut(axes: dict[int, np.ndarray], double: bool):
    """Cuts sorted vectors into blocks of one label and length."""
    kind = np.float64 if double else np.float32

    def block(place: int, key: tuple, rows: list) -> pa.RecordBatch:
        label, d = key
        raw = b"".join(r["raw"] for r in rows)
        p = _projected(axes, units(np.frombuffer(raw, kind).reshape(-1, d).astype(np.float64)))
        row = {"part": TaskContext.get().partitionId(), "place": place, "label": label, "d": d, "rows": len(rows), "low": p.min(axis=0), "high": p.max(axis=0), "raw": raw}
        row |= {c: [r[c] for r in rows] for c in ("k1", "k2", "least", "n")}
        return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("place", pa.int32()), ("label", pa.string()), ("d", pa.int32()), ("rows", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("low", "high")], *[(c, pa.list_(pa.int64())) for c in ("k1", "k2", "least", "n")], ("raw", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, key, rows = 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["label"], row["d"])
                if rows and (own != key or len(rows) == BLOCK):
                    yield block(place, key, rows)
                    place, rows = place + 1, []
                key = own
                rows.append(row)
        if rows:
            yield block(place, key, rows)

    return run


def _levels(blocks: DataFrame) -> list[DataFrame]:
    """Tables (id, label0, label1, d0, d1, low, high) of the intervals, from the blocks up to one root."""
    levels = [written(blocks.select("id", F.col("label").alias("label0"), F.col("label").alias("label1"), F.col("d").alias("d0"), F.col("d").alias("d1"), "low", "high"), "intervals")]
    many = levels[0].count()
    while many > 1:
        ends = [F.min("label0").alias("label0"), F.max("label1").alias("label1"), F.min("d0").alias("d0"), F.max("d1").alias("d1")]
        ends += [F.array(*[side(F.col(c)[i]) for i in range(AXES)]).alias(c) for side, c in ((F.min, "low"), (F.max, "high"))]
        levels.append(written(levels[-1].groupBy(F.expr(f"id div {FAN}").alias("id")).agg(*ends), "intervals"))
        many = -(-many // FAN)
    return levels


def _near(x: str, y: str, epsilon: float) -> Column:
    """Whether two intervals share labels and lengths and have extents within epsilon of each other."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    gaps = [F.greatest(F.lit(0.0), a("low")[i] - b("high")[i], b("low")[i] - a("high")[i]) for i in range(AXES)]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon + OFF
    return (a("label0") <= b("label1")) & (b("label0") <= a("label1")) & (a("d0") <= b("d1")) & (b("d0") <= a("d1")) & near


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b), a <= b, of the blocks that may hold links, by descending the tree; a table."""
    levels = _levels(blocks)
    pairs = written(levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b")), "interval-pairs")
    for level in reversed(levels[:-1]):
        below = level.withColumn("above", F.expr(f"id div {FAN}"))
        met = pairs.join(below.alias("x"), F.col("a") == F.col("x.above")).join(below.alias("y"), (F.col("b") == F.col("y.above")) & (F.col("x.id") <= F.col("y.id")) & _near("x", "y", epsilon))
        next_pairs = written(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), "interval-pairs")
        forget(pairs)
        pairs = next_pairs
    for level in levels:
        forget(level)
    return pairs


class _Side:
    """A block in a task: its vectors, unit vectors, and the extents of its leaves and of halves of these."""

    def __init__(self, raw: bytes, d: int, n: list[int], axes: dict[int, np.ndarray], double: bool):
        self.rows = scaled(np.frombuffer(raw, np.float64 if double else np.float32).reshape(-1, d).astype(np.float64))
        self.unit, self.n = units(self.rows), np.array(n, np.int64)
        self.at = _projected(axes, self.unit)
        self.extents: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def extent(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        if (low, high) not in self.extents:
            own = self.at[low:high]
            self.extents[low, high] = own.min(axis=0), own.max(axis=0)
        return self.extents[low, high]


class Compared:
    """Links of two blocks, or of one with itself: how many each vector has, and a forest of them."""

    def __init__(self, x: _Side, y: _Side, threshold: float, same: bool, leaf: int):
        self.x, self.y, self.threshold, self.same, self.most = x, y, threshold, same, leaf
        self.reach = 2 - 2 * threshold + OFF
        self.links = [np.zeros(len(x.n), np.int64), np.zeros(len(y.n), np.int64)]
        # Components among the rows of both sides; of a block with itself, of one.
        self.root = np.arange(len(x.n) + (0 if same else len(y.n)))
        self.forest: list[tuple[int, int]] = []
        self.join(0, len(x.n), 0, len(y.n))

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Joins rows a to b of one side and c to d of the other; intervals too far apart are left out."""
        (low, high), (other_low, other_high) = self.x.extent(a, b), self.y.extent(c, d)
        gap = np.maximum(np.maximum(low - other_high, other_low - high), 0)
        if gap @ gap > self.reach:
            return
        if b - a <= self.most and d - c <= self.most:
            self.leaf(a, b, c, d)
            return
        halves = lambda i, j: [(i, j)] if j - i <= self.most else [(i, (i + j) // 2), ((i + j) // 2, j)]
        for i, j in halves(a, b):
            for k, m in halves(c, d):
                if not self.same or i <= k:
                    self.join(i, j, k, m)

    def leaf(self, a: int, b: int, c: int, d: int) -> None:
        cosine = self.x.unit[a:b] @ self.y.unit[c:d].T
        linked = cosine >= self.threshold
        i, j = np.nonzero(np.abs(cosine - self.threshold) <= OFF)
        if len(i):
            u, v = self.x.rows[a + i], self.y.rows[c + j]
            linked[i, j] = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v)) >= self.threshold
        if self.same and a == c:
            linked = np.triu(linked, 1)
        if not linked.any():
            return
        self.links[0][a:b] += linked @ self.y.n[c:d]
        self.links[1][c:d] += self.x.n[a:b] @ linked
        shift = 0 if self.same else len(self.x.n)
        for i in np.flatnonzero(linked.any(axis=1)):
            others = c + np.flatnonzero(linked[i])
            roots, first = np.unique(self.root[shift + others], return_index=True)
            own = self.root[a + i]
            for r, k in zip(roots.tolist(), first.tolist(), strict=True):
                if r != own:
                    self.root[self.root == r] = own
                    self.forest.append((a + int(i), int(others[k])))


def _compare(axes: dict[int, np.ndarray], threshold: float, double: bool):
    names = ["nodes", "links", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                a, b, d = (row[c].as_py() for c in ("a", "b", "d"))
                x = _Side(row["raw_a"].as_buffer(), d, row["n_a"].values.to_numpy(), axes, double)
                y = x if a == b else _Side(row["raw_b"].as_buffer(), d, row["n_b"].values.to_numpy(), axes, double)
                found = Compared(x, y, threshold, a == b, LEAF)
                if not found.forest:
                    continue
                held = [np.flatnonzero(k) for k in found.links]
                nodes, links = np.concatenate([a * BLOCK + held[0], b * BLOCK + held[1]]), np.concatenate([k[h] for k, h in zip(found.links, held, strict=True)])
                ends = np.array(found.forest, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64())) for v in (nodes, links, a * BLOCK + ends[:, 0], b * BLOCK + ends[:, 1])], names)

    return run


def _class_links(blocks: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float, double: bool) -> DataFrame:
    """(k1, k2, n, n_links, component_id) of every class, as a table."""
    sides = [blocks.select(F.col("id").alias(s), *([F.col("d")] if s == "a" else []), F.col("raw").alias(f"raw_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    found = written(met.mapInArrow(_compare(axes, threshold, double), "nodes array<long>, links array<long>, a array<long>, b array<long>"), "vector-links")
    counts = found.select(F.inline(F.arrays_zip("nodes", "links")).alias("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    forest = found.select(F.inline(F.arrays_zip("a", "b")))
    nodes = blocks.select("id", F.posexplode(F.arrays_zip("k1", "k2", "least", "n"))).select((F.col("id") * BLOCK + F.col("pos")).alias("node"), "col.*")
    reached = connected_components(forest)
    held = written(nodes.join(counts, "node", "left").join(reached.select(F.col("id").alias("node"), "component"), "node", "left"), "vector-nodes")
    # Components are of places in the grid order; what is asked for is the least id in each.
    leasts = held.where("component is not null").groupBy("component").agg(F.min("least").alias("reached"))
    named = held.join(leasts, "component", "left")
    out = named.select("k1", "k2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("reached", "least").alias("component_id"))
    return written(out, "vector-classes")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Rows of the same label, which isn't null, and of vectors of the same length are linked from a cosine of the
    threshold on, over 0, computed in doubles. Vectors that are null, empty, all 0, or hold a null or a
    component that isn't finite have no links. n_links counts other rows linked directly, equal vectors included;
    component_id is the least vec_id that links reach, kept whether that is the row's own. Rows that share a vec_id
    are rows of their own; rows without vec_id take part, and have a component_id if others in it have an id;
    they aren't kept.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    epsilon = math.sqrt(max(2 - 2 * threshold, 0.0)) + OFF
    double = dict(vectors.dtypes)["embedding"] != "array<float>"
    listed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    able = usable()
    key = lambda *c: F.when(able, F.xxhash64(*c))
    keys = [key("label", "embedding").alias("k1"), key(F.lit("other"), "embedding", "label").alias("k2")]
    classes = listed.where(able).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select("*", *keys), "vector-classes")
    axes = principal_axes(classes)
    many = classes.count()
    order = ["label", "d", "cell", "k1", "k2"]
    sorted_ = grid_keys(classes, axes, max(epsilon, 1e-6)).repartitionByRange(1 + many // RANGE, *order).sortWithinPartitions(*order)
    blocks = written(sorted_.mapInArrow(_cut(axes, double), _BLOCKS), "vector-blocks")
    before, starts = 0, []
    for r in blocks.groupBy("part").count().orderBy("part").collect():  # a row for each range
        starts.append((r["part"], before))
        before += r["count"]
    starts = vectors.sparkSession.createDataFrame(starts, "part int, start long")
    blocks = blocks.join(F.broadcast(starts), "part").withColumn("id", F.col("start") + F.col("place"))
    found = _class_links(blocks, block_pairs(blocks, epsilon), axes, threshold, double)
    rows = listed.select("vec_id", *keys)
    out = join_uneven(rows, found, ["k1", "k2"], "n", rows.count(), "vec_id")
    linked = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), linked.alias("component_id"), F.coalesce(linked == F.col("vec_id"), F.lit(False)).alias("kept"))
