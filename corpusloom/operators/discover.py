"""From filing indexes to the manifest of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ledgers import keep_first


def unpivot(block: DataFrame, columns: list[str], by: str = "seq") -> DataFrame:
    """Rows of parallel arrays, as many as the shortest has, with their place."""
    n = F.least(*[F.coalesce(F.size(c), F.lit(0)) for c in columns]) if len(columns) > 1 else F.coalesce(F.size(columns[0]), F.lit(0))
    cut = F.arrays_zip(*[F.slice(c, F.lit(1), F.greatest(n, F.lit(0))).alias(c) for c in columns])
    rest = [c for c in block.columns if c not in columns]
    rows = block.select(*rest, F.posexplode(cut).alias(by, "_x"))
    return rows.select(*rest, by, *[F.col(f"_x.{c}").alias(c) for c in columns])


def in_window(day: Column, low: str, high: str | None = None) -> Column:
    """Inclusive; no upper bound means today in UTC, and a null date is out."""
    top = F.lit(high).cast("date") if high else F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("date")
    return F.coalesce(tx.iso_date(day).between(F.lit(low).cast("date"), top), F.lit(False))


def shard_overlaps(start: Column, end: Column, low: str, high: str) -> Column:
    """Whether a shard's range meets the window; an unreadable range counts as meeting it."""
    a, b = tx.iso_date(F.trim(start)), tx.iso_date(F.trim(end))
    return a.isNull() | b.isNull() | ((a <= F.lit(high).cast("date")) & (b >= F.lit(low).cast("date")))


def manifest_rows(filings: DataFrame, archives: str, forms: list[str], low: str, high: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Primary rows of ``filings`` (cik, ticker, accessionNumber, form, filingDate, reportDate,
    primaryDocument, seq) in the window, first per accession; and what was odd about any of them."""
    form = tx.strip(F.coalesce("form", F.lit("")))
    wanted = filings.filter(form.isin(forms))
    undated = wanted.filter(tx.null_if_blank(F.col("filingDate")).isNull()).select("accessionNumber", F.lit("no filingDate").alias("problem"))
    rows = wanted.filter(in_window(F.trim("filingDate"), low, high))
    document = tx.null_if_blank(F.col("primaryDocument"))
    url = F.when(document.isNotNull(), tx.document_url(archives, F.col("cik"), F.col("accessionNumber"), document))
    made = rows.select(
        "cik", "ticker", tx.accession_dashed(F.col("accessionNumber")).alias("accession"), form.alias("form"), tx.null_if_blank(F.col("filingDate")).alias("filing_date"),
        tx.null_if_blank(F.col("reportDate")).alias("period_of_report"), F.lit("primary").alias("doc_type"), F.lit(None).cast("string").alias("exhibit_label"), document.alias("document"), url.alias("doc_url"), "seq",
    )
    made = keep_first(made, ("accession",))
    problems = undated
    for column, name in (("document", "no primaryDocument"), ("period_of_report", "no reportDate")):
        problems = problems.unionByName(made.filter(F.col(column).isNull()).select(F.col("accession").alias("accessionNumber"), F.lit(name).alias("problem")))
    return made, problems


def exhibit_rows(primaries: DataFrame, headers: DataFrame, archives: str, prefixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the exhibits of each primary, and those without a file name, which is never made up.

    ``headers``: accession, type, sequence, filename, description.
    """
    fit = headers.filter(tx.is_exhibit_type(F.col("type"), prefixes)).select(F.col("accession").alias("_a"), "type", "sequence", "filename")
    rows = primaries.drop("doc_type", "exhibit_label", "document", "doc_url").join(fit, F.col("accession") == F.col("_a")).drop("_a")
    named = rows.filter("filename is not null").select(
        "cik", "ticker", "accession", "form", "filing_date", "period_of_report", F.lit("exhibit").alias("doc_type"), F.trim("type").alias("exhibit_label"),
        F.col("filename").alias("document"), tx.document_url(archives, F.col("cik"), F.col("accession"), F.col("filename")).alias("doc_url"),
    )
    return named, rows.filter("filename is null").select("accession", "ticker", "type", "sequence")


def discover(recent: DataFrame, shards: DataFrame, headers: DataFrame, archives: str, forms: list[str], prefixes: list[str], low: str, high: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One manifest of recent filings, those of older shards and the exhibits of both; and its problems.

    A filing that several inputs name counts once, recent ones first; of rows of
    one accession and document one stays, primaries first. ``recent`` and
    ``shards`` are filings as in :func:`manifest_rows`, ``headers`` documents as
    in :func:`exhibit_rows`. Problems: accessionNumber, problem.
    """
    seq = lambda rows, n: rows.withColumn("seq", F.struct(F.lit(n).alias("source"), F.col("seq").cast("long").alias("place")))
    primaries, problems = manifest_rows(seq(recent, 0).unionByName(seq(shards, 1)), archives, forms, low, high)
    primaries = primaries.drop("seq")
    exhibits, unnamed = exhibit_rows(primaries, headers, archives, prefixes)
    rows = primaries.unionByName(exhibits)
    first = F.struct(F.when(F.col("doc_type") == "primary", 0).otherwise(1), F.coalesce("exhibit_label", F.lit("")))
    rows = keep_first(rows.withColumn("_first", first), ("accession", "document"), "_first").drop("_first")
    return rows, problems.unionByName(unnamed.select(F.col("accession").alias("accessionNumber"), F.lit("exhibit without a file name").alias("problem"))).distinct()


def _order() -> list[Column]:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return [blank("ticker"), blank("filing_date").desc(), blank("accession"), F.when(F.col("doc_type") == "primary", 0).otherwise(1), blank("document")]


def manifest_order(manifest: DataFrame) -> DataFrame:
    """Total order of a manifest: ticker, newest filing, accession, primary first, document."""
    return manifest.orderBy(*_order())


def placed(manifest: DataFrame) -> DataFrame:
    """``manifest`` with each row's ``place`` in that order, from 1.

    Rows are numbered among those of their ticker and date; only the counts, a
    row a ticker and date, are summed up in one place.
    """
    rows = manifest.withColumns({"_t": F.coalesce("ticker", F.lit("")), "_d": F.coalesce("filing_date", F.lit(""))})
    before = Window.orderBy("_t", F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_t", "_d").agg(F.count("*").alias("_n")).select("_t", "_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_t", "_d").orderBy(*_order())))
    return inside.join(counts, ["_t", "_d"]).withColumn("place", F.col("_b") + F.col("_i")).drop("_t", "_d", "_b", "_i")


def counters(manifest: DataFrame, headers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents by ticker, form and label, and the exhibit types seen."""
    count = lambda *by: manifest.groupBy(*by).agg(F.count("*").alias("n"))
    out = {"by_ticker": count("ticker"), "by_form": count("form", "doc_type"), "by_label": count("exhibit_label")}
    if headers is not None:
        out["types_seen"] = headers.groupBy("type").agg(F.count("*").alias("n"))
    return out


def match_universe(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Each wanted ticker with its one company; none or several is an error that names the ticker.

    ``known``: ticker, cik, company_name.
    """
    names = known.select(F.upper(F.trim("ticker")).alias("_t"), "cik", "company_name").distinct().groupBy("_t").agg(F.collect_list(F.struct("cik", "company_name")).alias("_m"))
    rows = wanted.select(F.upper(F.trim("ticker")).alias("ticker")).join(names, F.col("ticker") == F.col("_t"), "left")
    n = F.coalesce(F.size("_m"), F.lit(0))
    one = F.when(n == 1, F.col("_m")[0]).otherwise(F.raise_error(F.format_string("%s matches %d companies, not one", F.col("ticker"), n)))
    return rows.select("ticker", one.alias("_c")).select("ticker", tx.cik10(F.col("_c.cik")).alias("cik"), F.col("_c.company_name").alias("company_name"))
