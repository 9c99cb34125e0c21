"""Documents of a manifest to files and a ledger."""

from __future__ import annotations

import hashlib
import os
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.discover import manifest_order
from ..operators.ledgers import outstanding, to_fetch
from ..schemas import FETCHED
from . import sinks, tables


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's last entries, or none where nothing was fetched yet."""
    try:
        return tables.appended(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], FETCHED)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """path and length of the files of a store; their content is not read."""
    if not os.path.isdir(store):
        return spark.createDataFrame([], "path string, length long")
    return spark.read.format("binaryFile").load(store).select(local(F.col("path")).alias("path"), "length")


def local(path):
    """A path as the ledger has it, without the scheme that file listings put before it."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def pending(manifest: DataFrame, ledger: DataFrame, store: str, limit: int | None = None, force: bool = False) -> DataFrame:
    """Rows to fetch in the manifest's order: those with an address and, unless forced, without a good file. The first ``limit``."""
    spark = manifest.sparkSession
    rows = manifest.filter("doc_url is not null")
    if not force:
        rows = to_fetch(rows, ledger.withColumn("seq", F.lit(0)), stored(spark, store))
    rows = manifest_order(rows)
    return rows.limit(limit) if limit is not None else rows


def fetch(manifest: DataFrame, store: str, ledger: str, client, allowed: list[str] | None = None, limit: int | None = None, force: bool = False, every: int = 50, log=None) -> dict[str, int]:
    """Fetch what is outstanding into ``store``; entries are appended to the ledger every ``every`` documents.

    Requests are made in one place and in turn, since the permitted rate is one
    requester's. A file appears under its name when it is complete. A document
    that can't be had gets an entry that says so, and the others go on; so do
    those of a type that is not allowed. Rows without an address are counted.
    Gives the counts of ok, error and unaddressed.
    """
    spark = manifest.sparkSession
    rows = pending(manifest, ledger_of(spark, ledger), store, limit, force)
    named = rows.select("accession", "document", "doc_type", "doc_url", tx.stored_name(F.col("accession"), F.coalesce("doc_type", F.lit("primary")), F.col("document"), F.lit("")).alias("stem"))
    counts, held = {"ok": 0, "error": 0, "unaddressed": manifest.filter("doc_url is null").count()}, []

    def flush() -> None:
        if held:
            sinks.append(spark.createDataFrame(held, FETCHED), ledger)
            held.clear()

    try:
        for row in named.toLocalIterator():
            path, status, size, kind, digest = None, "ok", None, None, None
            try:
                kind, body = client.fetch(row["doc_url"])
                media = kind.partition(";")[0].strip().lower()
                if allowed is not None and media and media not in [a.lower() for a in allowed]:
                    raise ValueError(f"{row['doc_url']}: {kind} is no type to keep")
                path = f"{store}/{row['stem']}{'.txt' if 'plain' in media else '.html'}"
                size, digest = sinks.replace_file(path, body), hashlib.sha256(body).hexdigest()
            except (OSError, ValueError) as e:
                path, status = None, "error"
                if log is not None:
                    log.error(str(e), accession=row["accession"], document=row["document"])
            counts[status] += 1
            if log is not None and status == "ok":
                log.count(items=1, bytes=size, requests=1)
            held.append((row["accession"], row["document"], row["doc_type"], path, status, None if size is None else str(size), kind, digest, datetime.now(UTC).isoformat()))
            if len(held) >= every:
                flush()
    finally:
        flush()
    return counts


def fetched(manifest: DataFrame, ledger: DataFrame, store: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows with the ``html`` of their file, and those without one."""
    spark = manifest.sparkSession
    rows = manifest.join(ledger.filter("status = 'ok'").select("accession", F.coalesce("document", F.lit("")).alias("_d"), tx.stored_path(F.col("path")).alias("_p")), "accession", "left")
    rows = rows.filter(F.coalesce("document", F.lit("")) == F.col("_d"))
    files = tables.raw_documents(spark, store).select(local(F.col("path")).alias("_p"), F.col("text").alias("html"))
    good = rows.join(files, "_p").drop("_p", "_d")
    return good, outstanding(manifest, good.select("accession", "document"))
