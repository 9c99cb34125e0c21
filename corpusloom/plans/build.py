"""Documents to a searchable index, resumably, and an index to hits.

One table holds vectors and metadata, so the two can't get out of step; the
sidecar is written before the first row, so an interrupted build still says
what it was building, and resuming compares the embedder too.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import embedders
from ..config import chunk_fingerprint
from ..functions.html import INLINE, visible
from ..functions.text import refuse_foreign
from ..operators import chunks as ck
from ..operators import dense, fusion, lexical
from ..operators.ledgers import outstanding
from ..schemas import HIT


def documents(raw: DataFrame, inline: frozenset[str] = INLINE) -> DataFrame:
    """Raw documents (…, html) with their visible text."""
    return raw.withColumn("text", visible(F.col("html"), inline)).drop("html")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _described(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.text(f"{path}/sidecar", wholetext=True).first()[0])
    except AnalysisException:
        return None


def embed_index(chunks: DataFrame, path: str, embedder: str, options: dict | None = None, fingerprint: str = "", limit: int | None = None, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """Embed the chunks that ``path`` does not hold yet; the index and the chunks that were too long.

    Refuses to add to an index of another embedder, width or chunking.
    """
    spark = chunks.sparkSession
    model = embedders.get(embedder, **(options or {}))
    want = {"embedder": model.describe(), "chunk_fingerprint": fingerprint, "dim": model.dim, "metric": "inner_product"}
    have = None if rebuild else _described(spark, path)
    if have is not None and {k: have.get(k) for k in want} != want:
        raise ValueError(f"{path} was built with {have}, not {want}; rebuild it or use another path")
    rows = chunks.orderBy("row").limit(limit) if limit else chunks
    good, long_ = ck.split_overlong(rows, model.max_seq_tokens)
    done = None if rebuild else _existing(spark, f"{path}/rows")
    todo = outstanding(good, done.select("chunk_id"), ("chunk_id",)) if done is not None else good
    spark.createDataFrame([(json.dumps(want, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")
    embedders.embed(todo, embedder, options).write.mode("overwrite" if rebuild or done is None else "append").parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows"), long_


def sidecar(spark: SparkSession, path: str) -> dict:
    """The index's description with its count."""
    return (_described(spark, path) or {}) | {"count": spark.read.parquet(f"{path}/rows").count()}


def build_index(raw: DataFrame, path: str, how, anchors: dict, embedder: str = "hashing", options: dict | None = None, least: int = 200, preamble: str | None = None, limit: int | None = None, rebuild: bool = False, foreign: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """HTML documents to an index of chunks with vectors and postings; its rows, and the chunks that were too long.

    Texts that begin with a prompt prefix in ``foreign`` stop the build.
    """
    from ..sources.tables import numbered

    made = ck.chunk(documents(raw), how, anchors, least, preamble)
    if foreign:
        made = made.withColumn("text", refuse_foreign(F.col("text"), foreign))
    rows, long_ = embed_index(numbered(made, "accession", "document", "chunk_ordinal"), path, embedder, options, chunk_fingerprint(anchors, least, preamble, how, INLINE), limit, rebuild)
    lexical.build(rows.select("row", "text")).save(f"{path}/lexical")
    return rows, long_


def build(raw: DataFrame, path: str, how, anchors: dict, embedder: str = "hashing", options: dict | None = None, least: int = 200, preamble: str | None = None) -> DataFrame:
    """The rows that :func:`build_index` makes of all documents."""
    return build_index(raw, path, how, anchors, embedder, options, least, preamble)[0]


class Retriever:
    """Lexical, dense or hybrid search over an index; every kind gives the same hits table."""

    def __init__(self, spark: SparkSession, path: str, embedder: str = "hashing", options: dict | None = None) -> None:
        self.spark, self.rows = spark, spark.read.parquet(f"{path}/rows")
        self.model = embedders.get(embedder, **(options or {}))
        told, n = sidecar(spark, path), self.rows.select("chunk_id").distinct().count()
        dense.check(told["embedder"] | {"dim": told["dim"]}, self.model.describe(), n, told["count"])
        self.index = lexical.Index.load(spark, f"{path}/lexical")
        if (held := self.index.stats.first()["n"]) != n:
            raise ValueError(f"the lexical index has {held} chunks, the vectors {n}")

    def search(self, queries: DataFrame, top: int = 20, kind: str = "dense") -> DataFrame:
        """Hits of ``queries`` (qid, text)."""
        if kind == "lexical":
            ranked, digits = lexical.search(self.index, queries, top), 6
        else:
            asked = [(r["qid"], self.model.embed_query(r["text"]).tolist()) for r in queries.select("qid", "text").toLocalIterator()]
            vectors = self.spark.createDataFrame(asked, T.StructType([queries.schema["qid"], T.StructField("embedding", T.ArrayType(T.FloatType()))]))
            if kind == "dense":
                ranked, digits = dense.search(self.rows, vectors, top), 6
            elif kind == "hybrid":
                ranked, digits = fusion.hybrid(self.index, queries, self.rows, vectors, top), 8
            else:
                raise ValueError(f"unknown kind of search {kind!r}; there are lexical, dense and hybrid")
        return fusion.hits(ranked, self.rows.drop("embedding"), digits).select("qid", *HIT)
