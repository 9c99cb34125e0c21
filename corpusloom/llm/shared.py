"""Shared-folder tables, row keys and Arrow plumbing of the operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import in_chunks

#: The ASCII white space that separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Words of 64 bits in a filter of rows, 4 MB; bytes of an Arrow batch of texts or sets, which the JVM and Python hold at a time.
_WORDS, _BATCH = 1 << 19, 1 << 22

_written: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; a temporary folder then
    stands in for it. On a cluster its absence is an error, as executors would
    write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _written.pop(path, None)


def _forget() -> None:
    """Remove this session's tables; a session that has ended already is left alone."""
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            _delete(spark, list(_written))
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


atexit.register(_forget)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends rows to Python in Arrow batches of about ``_BATCH`` bytes, a longer row in one of its own; a limit that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(_BATCH))
    try:
        yield
    finally:
        spark.conf.unset(name)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs at most the running
    stage, and it computes ``df`` once for all its readers. The size of the
    files is known to the planner, which broadcasts a table only below
    spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{folder}/{label}")
    _written[folder] = None
    table = spark.read.schema(df.schema).parquet(f"{folder}/{label}")
    table._corpusloom_folder = folder
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more; others are left alone."""
    for table in tables:
        folder = getattr(table, "_corpusloom_folder", None)
        if folder in _written:
            _delete(table.sparkSession, [folder])


def parts(df: DataFrame, each: int = 32 << 20) -> int:
    """Tasks that the files under ``df`` make at ``each`` bytes, and at least one for every core.

    Read from the plan's statistics, so nothing runs; leaves of unknown size don't count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(df.sparkSession.sparkContext.defaultParallelism, sum(x for x in sizes if x < 1 << 60) // each)


def sieve(rows: DataFrame, names: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose ``names`` may be a row of ``wanted`` (as many columns, in that order): all that are, and few others.

    A Bloom filter: four bits for each row of ``wanted`` in one word of 64, four
    rows a word or fewer, but no more than ``_WORDS`` words, which bounds what is
    broadcast; beyond, more rows pass. An exact join of those that pass is to follow.
    """
    words = min(_WORDS, 16 << (wanted.count() // 64).bit_length())

    def places(columns: list[str]) -> list[Column]:
        word, bits = F.pmod(F.xxhash64(*columns, F.lit(1)), F.lit(words)), F.xxhash64(*columns, F.lit(2))
        one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)]
        return [F.shiftright(word, 4).alias("_line"), (word.bitwiseAND(15) + 1).cast("int").alias("_at"), one[0].bitwiseOR(one[1]).bitwiseOR(one[2]).bitwiseOR(one[3]).alias("_mask")]

    line = F.array(*[F.bit_or(F.when(F.col("_at") == i + 1, F.col("_mask")).otherwise(F.lit(0).cast("long"))) for i in range(16)])
    lines = wanted.select(places(wanted.columns)).groupBy("_line").agg(line.alias("_bits")).withColumnRenamed("_line", "_of")
    met = (F.col("_line") == F.col("_of")) & (F.element_at("_bits", F.col("_at")).bitwiseAND(F.col("_mask")) == F.col("_mask"))
    return rows.select("*", *places(names)).join(F.broadcast(lines), met, "left_semi").drop("_line", "_at", "_mask")  # at most _WORDS words


def keep_rows(docs: DataFrame, key: Column, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``verdicts`` has one row for each (doc_id, key) of ``docs``: ``stays``, and
    ``single`` where of several such rows only one stays. Only the rows that go
    are joined with, so texts are not moved as long as those are few.
    """
    gone = materialize(verdicts.filter("not stays or single").select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), "stays"), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", key.alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    kept = rows.join(gone, same, "left_anti").select("_row")
    some = gone.filter("stays")
    if not some.isEmpty():
        kept = kept.unionByName(rows.join(some, same, "left_semi").dropDuplicates(["doc_id", "_key"]).select("_row"))
    return kept.select("_row.*")


def text_key(text: Column) -> Column:
    """64-bit key that tells rows of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_columns(docs: DataFrame) -> DataFrame:
    """doc_id, at, key and text of each row; (at, key) never is null and tells rows apart.

    ``at`` is the id (0 for null), ``key`` hashes the text and whether the id is
    null. Plain equality on the two serves joins, so that they can share one
    exchange of the texts.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("at"), F.xxhash64(text, F.col("doc_id").isNull()).alias("key"), text.alias("text"))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids fall in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(column: pa.Array, most: int) -> Iterator[slice]:
    """Consecutive slices of a column of strings or binaries with about ``most`` bytes each, so that Python need hold no more of them at once."""
    return in_chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most)


def trim() -> None:
    """Give this process's free memory back."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        give(0)


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function``, whose worker gives free memory back when a task ends; idle workers stay beside the JVM for a minute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            trim()

    return run


def regroup(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Batches joined into tables of about ``most_bytes``, so that memory is bounded by it."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            held.append(piece)
            size += piece.get_total_buffer_size() if step >= batch.num_rows else piece.nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
