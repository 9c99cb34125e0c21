"""Ledger-keyed incremental processing: what is left to do, and state by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCUMENT = ("accession", "document")


def _key(df: DataFrame, names: tuple[str, ...]) -> Column:
    return F.struct(*[F.coalesce(df[n].cast("string"), F.lit("")).alias(n) for n in names])


def latest(ledger: DataFrame, key: tuple[str, ...] = DOCUMENT, sequence: str = "seq") -> DataFrame:
    """The last entry of each key; an aggregate, so a long history is merged before the shuffle."""
    rest = F.struct(*ledger.columns)
    return ledger.groupBy(_key(ledger, key).alias("_k")).agg(F.max_by(rest, F.col(sequence)).alias("_r")).select("_r.*")


def keep_first(rows: DataFrame, key: tuple[str, ...], order: str = "seq") -> DataFrame:
    """The first row of each key in source order."""
    return rows.groupBy(_key(rows, key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")


def duplicates(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, and how many rows are beyond the first."""
    return rows.groupBy(_key(rows, key).alias("key")).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def outstanding(wanted: DataFrame, done: DataFrame, key: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """Rows of ``wanted`` without a counterpart in ``done``; null key fields count as empty."""
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    seen = done.select(*[text(k).alias(f"_done_{k}") for k in key])  # names of their own, so that both sides may come from one table
    return wanted.join(seen, reduce(lambda a, b: a & b, [text(k) == F.col(f"_done_{k}") for k in key]), "left_anti")


def to_fetch(manifest: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Documents without an entry that is ok and whose file has the recorded size.

    ``files``: path, length. Failed entries are tried again.
    """
    ok = latest(ledger).filter("status = 'ok'")
    good = ok.join(files.select(F.col("path").alias("p"), "length"), (F.replace("path", F.lit("\\"), F.lit("/")) == F.col("p")) & (F.col("bytes").cast("long") == F.col("length")))
    return outstanding(manifest, good.select(*DOCUMENT))


def to_parse(documents: DataFrame, ledger: DataFrame, fingerprint: str, outputs: DataFrame) -> DataFrame:
    """Documents (accession, document, doc_sha256) whose sha or configuration changed, or whose output is gone."""
    good = latest(ledger).filter(F.col("config_fingerprint") == fingerprint).join(outputs.select("path").distinct(), "path", "left_semi")
    return outstanding(documents, good.select(*DOCUMENT, "doc_sha256"), (*DOCUMENT, "doc_sha256"))


def split_available(manifest: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows whose last entry is ok, with its path and sha, and the others."""
    last = latest(ledger).select(F.col("accession").alias("_a"), F.coalesce("document", F.lit("")).alias("_d"), "path", "sha256", "status")
    rows = manifest.join(last, (F.col("accession") == F.col("_a")) & (F.coalesce("document", F.lit("")) == F.col("_d")), "left").drop("_a", "_d")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def migrate(legacy: DataFrame, manifest: DataFrame) -> DataFrame:
    """A ledger from before exhibits: its entries are primaries, whose document the manifest knows."""
    primary = manifest.filter(F.coalesce("doc_type", F.lit("primary")) == "primary").select(F.col("accession").alias("_a"), F.col("document").alias("_d"))
    rows = legacy.join(primary, F.col("accession") == F.col("_a"), "left")
    return rows.select("*", F.coalesce("_d", F.lit("")).alias("document"), F.lit("primary").alias("doc_type")).drop("_a", "_d")
