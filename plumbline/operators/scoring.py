"""Scores of queries and rows that both are few dimensions with weights, where the rows lie.

Queries are sent to the tasks as lists by dimension. A task reads its rows some at a time, adds up products in a
matrix of rows and queries, and keeps the best of each query, so that neither pairs nor products are rows of a table. What
the largest weights of the dimensions can't bring to a query's last place so far is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

#: Scores of a step, rows times queries; places to which scores are compared; what a bound may be off by.
STEP, PLACES, OFF = 1 << 20, 9, 1e-6


@dataclass
class Rows:
    """Rows of a batch: their names, and their entries as places of rows, of dimensions, and weights, no dimension of a row twice."""

    names: list
    row: np.ndarray
    dim: np.ndarray
    weight: np.ndarray


class Lists:
    """Queries as lists by dimension: of each dimension which queries have it, with what weight."""

    def __init__(self, ids: pa.Array, query: np.ndarray, dim: np.ndarray, weight: np.ndarray, dims: int):
        order = np.argsort(dim, kind="stable")
        self.ids, self.n, self.dims = ids, len(ids), dims
        self.query, self.dim, self.weight = query[order], dim[order], weight[order].astype(np.float64)
        self.starts = np.searchsorted(self.dim, np.arange(dims + 1))
        self.most = np.zeros(dims)
        np.maximum.at(self.most, self.dim, np.abs(self.weight))


def entries(key: np.ndarray, dim: np.ndarray, weight: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with those of the same key and dimension added up."""
    both, place = np.unique(key.astype(np.int64) * dims + dim, return_inverse=True)
    return both // dims, both % dims, np.bincount(place, weight, len(both))


class Best:
    """The best rows of each query so far: equal scores, to PLACES, by name."""

    def __init__(self, lists: Lists, top_k: int):
        self.lists, self.top_k = lists, top_k
        self.query, self.score, self.names = np.zeros(0, np.int64), np.zeros(0), None
        self.last = np.full(lists.n, -np.inf)
        self.passed = 0

    def add(self, rows: Rows) -> None:
        """Scores rows, and keeps what is good enough."""
        lists, n = self.lists, len(rows.names)
        row, dim, weight = rows.row, rows.dim, rows.weight
        reach = np.bincount(row, np.abs(weight) * lists.most[dim], n)
        alive = reach >= self.last.min() - OFF
        self.passed += int(n - alive.sum())
        kept = alive[row]
        row, dim, weight = row[kept], dim[kept], weight[kept]
        if not len(row):
            return
        most = np.zeros(lists.dims)
        np.maximum.at(most, dim, np.abs(weight))
        asked = np.bincount(lists.query, np.abs(lists.weight) * most[lists.dim], lists.n) >= self.last - OFF
        scores, met = np.zeros((lists.n, n)), np.zeros((lists.n, n), bool)
        order = np.argsort(dim, kind="stable")
        row, dim, weight = row[order], dim[order], weight[order]
        cuts = np.append(np.flatnonzero(np.diff(dim, prepend=-1)), len(dim))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = slice(lists.starts[dim[low]], lists.starts[dim[low] + 1])
            query = lists.query[own]
            some = asked[query]
            if some.any():
                at = np.ix_(query[some], row[low:high])
                scores[at] += lists.weight[own][some][:, None] * weight[low:high]
                met[at] = True
        met &= np.round(scores, PLACES) >= np.round(self.last, PLACES)[:, None]
        query, place = np.nonzero(met)
        self.keep(query, scores[query, place], np.array(rows.names, dtype=str if isinstance(rows.names[0], str) else None)[place])

    def keep(self, query: np.ndarray, score: np.ndarray, names: np.ndarray) -> None:
        if not len(query):
            return
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        names = names if self.names is None else np.concatenate([self.names, names])
        order = np.lexsort((names, -np.round(score, PLACES), query))
        query, score, names = query[order], score[order], names[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        first = nth < self.top_k
        self.query, self.score, self.names = query[first], score[first], names[first]
        full = nth == self.top_k - 1
        self.last[query[full]] = score[full]


def best_rows(rows: DataFrame, lists: Lists, read: Callable[[pa.RecordBatch], Rows], top_k: int, schema) -> DataFrame:
    """(sample_id, chunk_id, score), by schema: of every task the best top_k rows of each query, of those that share a dimension with it."""
    sent = rows.sparkSession.sparkContext.broadcast(lists)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value, top_k)
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, STEP // sent.value.n)):
                best.add(read(batch.slice(at, max(1, STEP // sent.value.n))))
        if len(best.query):
            yield pa.RecordBatch.from_arrays([sent.value.ids.take(pa.array(best.query)), pa.array(best.names.tolist(), kinds[1]), pa.array(best.score, pa.float64())], ["sample_id", "chunk_id", "score"])

    return rows.mapInArrow(run, schema)
