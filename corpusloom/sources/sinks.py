"""Writers. Tables go through Spark's committer; small control files are written whole and renamed."""

from __future__ import annotations

import csv as _csv
import io
import json
import uuid
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.discover import manifest_order
from ..schemas import MANIFEST


def replace_file(path: str, data: bytes) -> int:
    """Atomic: readers see the old file or the new one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    return len(data)


def control_csv(df: DataFrame, path: str, schema: T.StructType) -> int:
    """A control table as one CSV file with fixed columns and line feeds; null is an empty cell.

    For tables of the size of a manifest, row by row through the driver; corpora
    go to :func:`table`.
    """
    out = io.StringIO(newline="")
    writer = _csv.writer(out, lineterminator="\n")
    writer.writerow(schema.fieldNames())
    for row in df.select(*schema.fieldNames()).toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return replace_file(path, out.getvalue().encode("utf-8"))


def manifest(df: DataFrame, path: str) -> int:
    """In total order, so that the same rows give the same bytes."""
    return control_csv(manifest_order(df), path, MANIFEST)


def table(df: DataFrame, path: str, by: str | None = None, mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def chunks_jsonl(chunks: DataFrame, path: str) -> None:
    """Chunk records as JSON lines, in order within each document."""
    out = chunks.withColumn("char_span", F.array("char_span.start", "char_span.end"))
    out.repartition("accession", "document").sortWithinPartitions("accession", "document", "chunk_ordinal").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append(ledger: DataFrame, path: str) -> None:
    """Append ledger entries with the moment they were written as their sequence."""
    ledger.withColumn("seq", F.struct(F.current_timestamp().alias("at"), F.monotonically_increasing_id().alias("n"))).write.mode("append").parquet(path)


def rewrite(ledger: DataFrame, path: str) -> str:
    """The ledger's entries as one new generation beside the old one, which stays until the new one is complete."""
    spark = ledger.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, fresh = at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    append(ledger, fresh.toString())
    fs.delete(at, True)
    if not fs.rename(fresh, at):
        raise OSError(f"{fresh.toString()} holds the ledger; it could not be renamed to {path}")
    return path


def report(parts: dict, path: str) -> int:
    """A small report of values and DataFrames as one JSON file."""
    plain = lambda v: [r.asDict(recursive=True) for r in v.toLocalIterator()] if isinstance(v, DataFrame) else v
    return replace_file(path, json.dumps({k: plain(v) for k, v in parts.items()}, indent=1, sort_keys=True, default=str).encode())
