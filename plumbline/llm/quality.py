"""Quality classification by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: words hashed into buckets, weighted by the root of their share, and one
feature for the bin that each statistic falls into (the text's own length among them, which is its metadata).
The score is the logistic of w0 + sum(w x) + 1/2 sum_f((sum(v_f x))^2 - sum(v_f^2 x^2)): all pairs of features
interact through vectors of low rank, in time linear in the number of features present.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_bytes, with_columns

#: Buckets of hashed words, bins of each statistic, rank of the interactions.
BUCKETS, BINS, RANK = 1 << 13, 12, 8
#: At most so many labelled rows are learnt from, the first by a hash of doc_id.
SAMPLE = 4000
#: predicted is 1 from this score on.
THRESHOLD = 0.3
_MEMO = 50_000
_BUCKET: dict[bytes, int] = {}
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SPACE, _MARK = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_POINT = b".,;:!?"
STATISTICS = ("length", "words", "word_length", "upper", "digit", "mark", "point", "other", "distinct", "top_word", "repeated_line", "repeated_triple", "line_length", "double_point")


def describe(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, statistics) of a whole text."""
    words = data.split()
    counts = Counter(words)
    if len(_BUCKET) > _MEMO:
        _BUCKET.clear()
    for w in [w for w in counts if w not in _BUCKET]:
        _BUCKET[w] = zlib.crc32(w.strip(_POINT + b"\"'()").lower()) % BUCKETS
    n, size = max(1, len(words)), max(1, len(data))
    buckets = np.fromiter(map(_BUCKET.__getitem__, counts), np.int32, len(counts))
    weights = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / n)
    share = lambda of: (len(data) - len(data.translate(None, of))) / size
    upper, lower, digit, space, mark, point = map(share, (_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _POINT))
    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = len(words) - 2
    statistics = np.array(
        [
            np.log1p(len(data)), np.log1p(len(words)), len(data) * (1 - space) / n, upper, digit, mark, point, 1 - upper - lower - digit - space - mark - point,
            len(counts) / n, max(counts.values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)),
            1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 0.0,  # noqa: B905
            np.log1p(size / max(1, len(lines))), data.count(b"!!") / n,
        ],
        np.float64,
    )
    return buckets, weights, statistics


@dataclass
class FactorisationMachine:
    """bias, linear weights and factors by feature; edges are the statistics' bins."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def features(self, described) -> tuple[np.ndarray, np.ndarray]:
        buckets, weights, statistics = described
        bins = [BUCKETS + s * BINS + int(np.searchsorted(e, x, "right")) for s, (e, x) in enumerate(zip(self.edges, statistics, strict=True))]
        return np.concatenate([buckets, np.array(bins, np.int32)]), np.concatenate([weights, np.full(len(bins), 1 / np.sqrt(len(bins)), np.float32)])

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[ids] * x[:, None]
        both = vx.sum(0)
        return float(self.bias + self.linear[ids] @ x + 0.5 * (both @ both - np.einsum("ij,ij->", vx, vx)))

    def score(self, data: bytes) -> float:
        ids, x = self.features(describe(data))
        return float(1 / (1 + np.exp(-np.clip(self.margin(ids, x), -30, 30))))


def fit(described: list, labels: np.ndarray, rounds: int = 10, batches: int = 8, rate: float = 0.06, shrink: float = 2e-4) -> FactorisationMachine:
    """Logistic loss by Adam in small batches; always the same for the same rows in the same order.

    Without rows of both labels the score is the smoothed share of label 1 for every text.
    """
    n = len(labels)
    prior = (float(labels.sum()) + 0.5) / (n + 1)
    width, rng = BUCKETS + len(STATISTICS) * BINS, np.random.default_rng(7)
    stats = np.array([d[2] for d in described]).reshape(n, len(STATISTICS))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if n else np.zeros((len(STATISTICS), BINS - 1))
    model = FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), edges)
    if not n or labels.min() == labels.max():
        return model
    model.factors = rng.normal(0, 0.05, (width, RANK)).astype(np.float32)
    found = [model.features(d) for d in described]
    dealt = []
    for picked in np.array_split(rng.permutation(n), min(n, batches)):
        own = [found[i] for i in picked]
        sizes = [len(ids) for ids, _ in own]
        ids, x = np.concatenate([f[0] for f in own]), np.concatenate([f[1] for f in own]).astype(np.float32)
        by_feature = np.argsort(ids, kind="stable")
        present, firsts = np.unique(ids[by_feature], return_index=True)
        dealt.append((labels[picked].astype(np.float32), ids, x, np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(own)), sizes), by_feature, present, firsts))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.linear, model.factors)]
    bias_m, t = np.zeros(2), 0
    for _ in range(rounds):
        for wanted, ids, x, starts, row, by_feature, present, firsts in dealt:
            t += 1
            vx = model.factors[ids] * x[:, None]
            both = np.add.reduceat(vx, starts, axis=0)
            margin = model.bias + np.add.reduceat(model.linear[ids] * x, starts) + 0.5 * ((both**2).sum(1) - np.add.reduceat(np.einsum("ij,ij->i", vx, vx), starts))
            error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - wanted) / len(wanted)).astype(np.float32)
            pull = (error[row] * x)[by_feature]
            steps = [np.add.reduceat(pull, firsts), np.add.reduceat(pull[:, None] * (both[row] - vx)[by_feature], firsts, axis=0)]
            for parameter, (m, v), g in zip((model.linear, model.factors), moments, steps, strict=True):
                g = g + shrink * parameter[present]
                m[present] = 0.9 * m[present] + 0.1 * g
                v[present] = 0.99 * v[present] + 0.01 * g * g
                parameter[present] -= rate * (m[present] / (1 - 0.9**t)) / (np.sqrt(v[present] / (1 - 0.99**t)) + 1e-8)
            g = float(error.sum())
            bias_m = np.array([0.9 * bias_m[0] + 0.1 * g, 0.99 * bias_m[1] + 0.01 * g * g])
            model.bias -= rate * float(bias_m[0] / (1 - 0.9**t) / (np.sqrt(bias_m[1] / (1 - 0.99**t)) + 1e-8))
    return model


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 0 when divided by 5. A null is kept out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fits to labelled documents that aren't held out, at most sample of them, the same in every run.

    Rows without doc_id or quality teach nothing; of rows that share a doc_id, the text of least hash does. Only the
    sample's ids, statistics and word buckets come to the driver.
    """
    key = F.col("doc_id").cast("long")
    chosen = (
        labels.select(key.alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [describe(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(3)]], ["doc_id", "quality", "b", "w", "s"]
                )

    known = docs.select(key.alias("doc_id"), text_bytes().alias("content")).join(F.broadcast(chosen), "doc_id")
    one = known.groupBy("doc_id", "quality").agg(F.min_by("content", F.struct(F.xxhash64("content"), "content")).alias("content"))
    rows = sorted(one.mapInArrow(run, "doc_id long, quality int, b binary, w binary, s binary").collect(), key=lambda r: r["doc_id"])
    described = [(np.frombuffer(r["b"], np.int32), np.frombuffer(r["w"], np.float32), np.frombuffer(r["s"], np.float64)) for r in rows]
    return fit(described, np.array([r["quality"] for r in rows], np.float64))


def score_documents(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; an empty or null text is scored like any other.

    Rows are independent: repeated rows give repeated rows, a null doc_id stays null and counts as held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in with_columns(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([sent.value.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """The rows whose text scores at least THRESHOLD, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                good = [sent.value.score((t or "").encode()) >= THRESHOLD for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
