"""Documents to fully attributed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import windows as w

REQUIRED = ("cik", "accession", "form")
PROVENANCE = ("cik", "ticker", "accession", "form", "filing_date", "period")


def chunk(documents: DataFrame, how, anchors: dict[str, list[dict]], least: int = 200, preamble: str | None = None, flags: int = 2, exhibits_by_label: bool = True) -> DataFrame:
    """Chunks of ``documents``: sections, then windows, then numbering, all on the document's row.

    ``documents``: cik, ticker, accession, form, filing_date, period_of_report,
    doc_type, document, exhibit_label, text. Ordinals run on over sections and
    skip blank windows. A missing cik, accession or form stops the job.
    """
    kind = F.coalesce("doc_type", F.lit("primary"))
    length = F.length(F.coalesce("text", F.lit("")))
    rows = w.with_spans(documents.withColumn("doc_type", kind), anchors, least, preamble, flags)
    label = tx.null_if_blank(F.col("exhibit_label"))
    whole = F.array(F.struct(label.alias("label"), F.lit(0).alias("start"), length.alias("end"))).cast(w.SPANS)
    rows = rows.withColumn("spans", F.when((F.col("doc_type") == "exhibit") & F.lit(exhibits_by_label), whole).otherwise(F.col("spans")))
    rows = w.unfold_windows(rows, how)
    for name in REQUIRED:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"chunk without {name}"))).otherwise(F.col(name)))
    blank = lambda c: tx.null_if_blank(F.col(c))
    return rows.select(
        "cik", blank("ticker").alias("ticker"), "accession", "form", blank("filing_date").alias("filing_date"),
        blank("period_of_report").alias("period"), "section", "chunk_ordinal",
        tx.chunk_id(F.col("accession"), F.col("document"), F.col("chunk_ordinal")).alias("chunk_id"),
        "text", F.col("n").alias("n_tokens"), F.struct("start", "end").alias("char_span"),
        "doc_type", blank("document").alias("document"), blank("exhibit_label").alias("exhibit_label"),
    )


def missing_provenance(chunks: DataFrame) -> DataFrame:
    """Chunks with null provenance fields, and which: kept in the corpus, but reported."""
    fields = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (*PROVENANCE, "section")]), lambda c: c.isNotNull())
    return chunks.select("chunk_id", fields.alias("missing")).filter(F.size("missing") > 0)


def split_overlong(chunks: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Chunks an embedder can take, and those with more than ``most`` tokens."""
    if most is None:
        return chunks, chunks.limit(0)
    return chunks.filter(F.col("n_tokens") <= most), chunks.filter(F.col("n_tokens") > most)


def section_distribution(chunks: DataFrame) -> DataFrame:
    """Chunks, characters and their per cent by form/doc_type and section."""
    group = F.concat_ws("/", "form", F.coalesce("doc_type", F.lit("primary"))).alias("grp")
    rows = chunks.groupBy(group, F.coalesce("section", F.lit("(unsectioned)")).alias("section"))
    rows = rows.agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    totals = rows.groupBy(F.col("grp").alias("g")).agg(F.sum("chars").alias("total"))
    rows = rows.join(totals, F.col("grp") == F.col("g")).drop("g")
    pct = F.when(F.col("total") > 0, F.round(100.0 * F.col("chars") / F.col("total"), 2)).otherwise(0.0)
    return rows.select("grp", "section", "chunks", "chars", pct.alias("pct"))


def most_common(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of the labels ``by``, commonest first, ties by label (null first): the labels, n and their ``place``.

    One row a label reaches the window that places them.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), *by)))


def heading_census(documents: DataFrame, pattern: str, width: int = 52, top: int = 6) -> DataFrame:
    """The commonest continuations of each numbered heading: item, tail, n."""
    from pyspark.sql import Window

    found = documents.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))
    rows = found.select(F.upper(F.regexp_extract("m", pattern, 1)).alias("item"), F.left(tx.collapse(F.regexp_extract("m", pattern, 2)), F.lit(width)).alias("tail"))
    rows = rows.groupBy("item", "tail").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item").orderBy(F.desc("n"), "tail")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def anchor_trial(sections: DataFrame, label: str) -> DataFrame:
    """How far one anchor reaches by ticker: documents hit, documents, its characters' and the unsectioned share.

    ``sections``: ticker, accession, spans.
    """
    each = sections.select("ticker", "spans", F.explode("spans").alias("s"))
    hit = F.exists("spans", lambda s: s["label"] == label)
    docs = sections.groupBy("ticker").agg(F.count_if(hit).alias("documents_hit"), F.count("*").alias("documents"))
    n = F.col("s.end") - F.col("s.start")
    size = each.groupBy(F.col("ticker").alias("t")).agg(F.sum(F.when(F.col("s.label") == label, n).otherwise(0)).alias("chars"), F.sum(F.when(F.col("s.label").isNull(), n).otherwise(0)).alias("unsectioned"), F.sum(n).alias("total"))
    return docs.join(size, F.col("ticker").eqNullSafe(F.col("t")), "left").drop("t")
