"""Exact inner-product search over unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .lexical import best_places, ranking

#: Query vectors sent along with one scan, by number of floats; more of them go in turns.
MOST_FLOATS = 1 << 24
#: Vectors a task holds at a time, by number of floats; queries it scores at a time.
HELD_FLOATS, BLOCK = 1 << 22, 64
#: Queries from which on the vectors are dealt out evenly before they are scanned.
MANY_QUERIES = 256


class InnerProduct:
    """Scores of rows for queries. What decides is each product summed in the order of its
    elements, so that equal vectors tie wherever they lie; a product of matrices, which
    differs from it by ``slack`` at most, only chooses what to sum."""

    @staticmethod
    def block(ids: np.ndarray, asked: np.ndarray, rows: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of some queries for all rows, and how far each query's may be off."""
        norm = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
        return asked @ held.T, 2.0**-51 * (asked.shape[1] + 1) * norm(asked) * norm(held).max(initial=0.0)

    @staticmethod
    def exact(query: int, asked: np.ndarray, rows: np.ndarray, held: np.ndarray) -> np.ndarray:
        return np.cumsum(held * asked, axis=1)[:, -1] if held.shape[1] else np.zeros(len(held))


def leading(scorer, query: int, asked: np.ndarray, score: np.ndarray, slack: float, rows: np.ndarray, held: np.ndarray, top: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of a query's best ``top`` rows, or all."""
    at = np.arange(len(rows))
    if top is not None and top < len(rows):
        at = np.flatnonzero(~(score < np.partition(score, len(score) - top)[len(score) - top] - 2 * slack))
    exact = np.concatenate([scorer.exact(query, asked, rows[x], held[x]) for x in np.array_split(at, len(at) // 4096 + 1)])
    best = best_places(exact, rows[at], top)
    return at[best], exact[best]


def matrix_of(lists: pa.Array) -> np.ndarray:
    """Vectors of one width as rows of doubles."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    width = {x for x in np.unique(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()}
    if len(width) > 1 or lists.null_count:
        raise ValueError("vectors are of different widths or null")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of (row, embedding), as many at a time as a task may hold."""
    rows, held, size = [], [], 0
    for batch in batches:
        if batch.num_rows:
            rows.append(batch.column(0).to_numpy(zero_copy_only=False))
            held.append(matrix_of(batch.column(1)))
            size += held[-1].size
        if size >= HELD_FLOATS:
            yield np.concatenate(rows), np.concatenate(held)
            rows, held, size = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(held)


def dealt(vectors: DataFrame, queries: int) -> DataFrame:
    """row and embedding, over all cores if there are queries enough to be worth a shuffle."""
    vectors = vectors.select(F.col("row").cast("long").alias("row"), "embedding")
    return vectors if queries < MANY_QUERIES else vectors.repartition(vectors.sparkSession.sparkContext.defaultParallelism)


def _scan(ids: pa.Array, matrix: np.ndarray, top: int | None, schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, held in pieces(batches):
            for a in range(0, len(ids), BLOCK):
                asked = matrix[a : a + BLOCK]
                score, slack = InnerProduct.block(None, asked, rows, held)
                best = [leading(InnerProduct, None, asked[i], score[i], slack[i], rows, held, top) for i in range(len(asked))]
                q = pa.array(np.repeat(np.arange(a, a + len(best)), [len(at) for at, _ in best]))
                yield pa.RecordBatch.from_arrays([ids.take(q), pa.array(rows[np.concatenate([at for at, _ in best])]), pa.array(np.concatenate([x for _, x in best]))], schema=schema)

    return scan


def turns(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of ``queries`` (qid, embedding), as many at a time as go with one scan."""
    asked = queries.select("qid", "embedding").toArrow().combine_chunks()
    if asked.num_rows:
        ids, matrix = asked.column(0).combine_chunks(), matrix_of(asked.column(1))
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        block = max(1, MOST_FLOATS // max(1, matrix.shape[1]))
        for a in range(0, len(ids), block):
            yield ids[a : a + block], matrix[a : a + block]


def united(queries: DataFrame, fields: list[T.StructField], scan: Callable[[pa.Array, np.ndarray, T.StructType], DataFrame]) -> DataFrame:
    """What the scans of all turns give: qid and ``fields``."""
    shape, found = T.StructType([queries.schema["qid"], *fields]), None
    for ids, matrix in turns(queries):
        one = scan(ids, matrix, shape)
        found = one if found is None else found.unionByName(one)
    return queries.sparkSession.createDataFrame([], shape) if found is None else found


def scores(vectors: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """qid, row and score of ``vectors`` (row, embedding) for ``queries`` (qid, embedding).

    Each scan scores a bounded number of vectors with a block of queries at a
    time and passes on the best ``top`` of them, or all. As many scans are
    united as the queries take turns.
    """

    def scan(ids: pa.Array, matrix: np.ndarray, shape: T.StructType) -> DataFrame:
        return dealt(vectors, len(ids)).mapInArrow(_scan(ids, matrix, top, to_arrow_schema(shape)), shape)

    return united(queries, [T.StructField("row", T.LongType()), T.StructField("score", T.DoubleType())], scan)


def search(vectors: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    return ranking(scores(vectors, queries, top), top)


def check(described: dict, live: dict, rows: int, count: int) -> None:
    """The guards of a retriever: the same embedder, and as many vectors as metadata rows."""
    if rows != count:
        raise ValueError(f"the index has {count} vectors and {rows} metadata rows")
    for name in ("model", "dim", "normalized"):
        if described.get(name) != live.get(name):
            raise ValueError(f"the index was built with {name} = {described.get(name)!r}, the embedder has {live.get(name)!r}")
