"""Ground-truth quotes to the chunks that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

THRESHOLD = 3
#: Needles up to which a corpus-wide search broadcasts them.
MANY_NEEDLES = 10_000


def normalised(chunks: DataFrame) -> DataFrame:
    """Chunks with ``norm``, the text quotes are looked for in."""
    return chunks.withColumn("norm", tx.collapse(F.col("text")))


def any_scope(value: Column) -> Column:
    return F.coalesce(F.upper(F.trim(value)) == "ANY", F.lit(False))


def containing(needles: DataFrame, chunks: DataFrame, keep: tuple[str, ...] = ("row",)) -> DataFrame:
    """needle and ``keep`` of each chunk (row, norm, ...) that holds it, whatever its scope.

    An inner word of a needle - complete in any text that holds it - is an equi
    key, and only needles of one or two words are scanned for. A few needles are
    broadcast, and of a text's words only their keys leave the one scan.
    """
    distinct, made = needles.select("needle").distinct(), ["needle", *keep]
    columns = list(dict.fromkeys([*keep, "norm"]))
    few = [r["needle"] for r in distinct.limit(MANY_NEEDLES + 1).collect()]
    if len(few) <= MANY_NEEDLES:
        key = {n: max(n.split(" ")[1:-1], key=len, default=None) for n in few}
        shape = "needle string, word string"
        of = lambda found: F.broadcast(needles.sparkSession.createDataFrame(found, shape))
        long_, short = ([(n, w) for n, w in key.items() if (w is None) == bare] for bare in (False, True))
        wanted = sorted({w for _, w in long_})
        held = chunks.select(*columns, F.explode(F.filter(F.array_distinct(F.split("norm", " ")), lambda w: w.isin(wanted))).alias("word"))
        rows = held.join(of(long_), "word").filter(F.contains("norm", "needle")).select(*made)
        return rows.unionByName(chunks.join(of(short), F.contains("norm", "needle")).select(*made)) if short else rows
    words = F.split("needle", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    keyed = distinct.withColumn("word", F.when(F.size(words) > 2, longest))
    held = chunks.select(*columns, F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    long_ = held.join(keyed.filter("word is not null"), "word").filter(F.contains("norm", "needle")).select(*made)
    short = chunks.join(keyed.filter("word is null").select("needle"), F.contains("norm", "needle")).select(*made)
    return long_.unionByName(short)


def asked(truths: DataFrame) -> DataFrame:
    """Truths with the needle of their quote and what their scope leaves open."""
    return truths.withColumns({
        "needle": F.when(F.coalesce("quote", F.lit("")) != "", tx.collapse(F.col("quote"))),
        "any": any_scope(F.col("accession")),
        "any_document": F.col("document").isNull() | any_scope(F.col("document")),
    })


def resolve(truths: DataFrame, chunks: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per truth (qid, member, ticker, accession, document, quote): status, chunks, spread.

    ``chunks``: row, chunk_id, ticker, accession, document, section, text and
    norm, as :func:`normalised` gives them. One scan finds the chunks that hold
    a needle, whatever its scope; chunks with one text hold the same needles, so
    the rest is counted among them.
    """
    t = asked(truths)
    body = ["row", "chunk_id", "accession", "document", "section", "ticker"]
    c = chunks.select("norm", *[F.col(x).alias(f"c_{x}") for x in body])
    held = containing(t.filter("needle is not null"), c, (*[f"c_{x}" for x in body], "norm"))
    held = held.withColumn("c_text", F.sha2("norm", 256)).drop("norm").withColumn("c_duplicates", F.count("*").over(Window.partitionBy("needle", "c_text")))
    inside = F.col("any") | (F.col("accession") == F.col("c_accession")) & (F.col("any_document") | (F.col("document") == F.col("c_document")))
    of = lambda x: F.when(F.col("inside"), x)
    several = lambda x: F.size(F.collect_set(x)).cast("long")
    found = t.select("qid", "member", "needle", "accession", "document", "any", "any_document").join(held, "needle").withColumn("inside", F.coalesce(inside, F.lit(False)))
    found = found.groupBy("qid", "member").agg(
        F.array_sort(F.collect_list(of(F.col("c_row")))).alias("rows"),
        F.transform(F.array_sort(F.collect_list(of(F.struct("c_row", "c_chunk_id")))), lambda x: x["c_chunk_id"]).alias("chunk_ids"),
        F.array_sort(F.collect_set(of(F.coalesce("c_section", F.lit("None"))))).alias("sections"),
        F.max(of(F.col("c_duplicates"))).alias("duplicate_text_count"),
        several(of(F.col("c_accession"))).alias("distinct_accessions"),
        several(of(F.col("c_text"))).alias("distinct_texts"),
        F.array_sort(F.collect_set(of(F.col("c_ticker")))).alias("distinct_tickers"),
        F.count("*").alias("corpus_chunks"), several(F.col("c_accession")).alias("corpus_accessions"),
        F.max("inside").alias("met"),
    ).filter("met").drop("met")
    indexed = chunks.select(F.col("accession").alias("i_accession")).distinct()
    named = t.filter("not any and not any_document").select(F.col("accession").alias("d_accession"), F.col("document").alias("d_document"))
    documents = chunks.select(F.col("accession").alias("d_accession"), F.col("document").alias("d_document")).join(named, ["d_accession", "d_document"], "left_semi").distinct()
    rows = t.join(found, ["qid", "member"], "left")
    rows = rows.join(indexed, F.col("accession") == F.col("i_accession"), "left")
    rows = rows.join(documents, (F.col("accession") == F.col("d_accession")) & (F.col("document") == F.col("d_document")), "left")
    n = F.coalesce(F.size("rows"), F.lit(0))
    status = (
        F.when(F.col("needle").isNull(), "no_quote")
        .when((n > 0) & F.col("any"), "dedup_measured")
        .when(n > threshold, "too_generic")
        .when(n > 0, "ok")
        .when(F.col("any"), "quote_absent")
        .when(F.col("i_accession").isNull(), "accession_not_indexed")
        .when(~F.col("any_document") & F.col("d_document").isNull(), "document_not_indexed")
        .otherwise("quote_absent")
    )
    keep = ["rows", "chunk_ids", "sections", "duplicate_text_count", "distinct_accessions", "distinct_texts", "distinct_tickers"]
    spread_cols = [F.when(n > 0, F.col(x)).alias(x) for x in ("corpus_chunks", "corpus_accessions")]
    return rows.select(*[c for c in truths.columns], "needle", status.alias("status"), n.alias("match_count"), *keep, *spread_cols)


def holders(truths: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid and accession of every accession that holds a question's quote, whatever the truth's scope."""
    t = asked(truths).filter("needle is not null").select("qid", "needle")
    return t.join(containing(t, chunks, ("accession",)), "needle").select("qid", "accession").distinct()


def resolved(status: Column) -> Column:
    return status.isin("ok", "too_generic", "dedup_measured")


def verify(truths: DataFrame, chunks: DataFrame, documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """As :func:`resolve`, telling quotes that no chunk holds whole from those the document lacks.

    ``documents`` (accession, document, text) are the texts as extracted;
    ``truths`` may carry key_status, where NEEDS_QUOTE marks a quote to come.
    """
    if "key_status" not in truths.columns:
        truths = truths.withColumn("key_status", F.lit(None).cast("string"))
    rows = resolve(truths, chunks, threshold)
    open_ = rows.filter((F.col("status") == "quote_absent") & ~any_scope(F.col("accession"))).select("qid", "member", "accession", "document", "needle")
    texts = documents.select(F.col("accession").alias("a"), F.coalesce("document", F.lit("")).alias("d"), tx.collapse(F.col("text")).alias("t"))
    exact = open_.join(texts, (F.col("accession") == F.col("a")) & (F.coalesce("document", F.lit("")) == F.col("d")))
    exact = exact.groupBy("qid", "member").agg(F.max(F.contains("t", "needle")).alias("exact"))
    # a named document that was not fetched falls back to the first of its accession
    first = documents.groupBy(F.col("accession").alias("a")).agg(F.min_by("text", F.coalesce("document", F.lit(""))).alias("t"))
    other = open_.filter("document is not null").join(first, F.col("accession") == F.col("a"))
    other = other.select("qid", "member", F.contains(tx.collapse(F.col("t")), F.col("needle")).alias("other"))
    rows = rows.join(exact, ["qid", "member"], "left").join(other, ["qid", "member"], "left")
    holds = F.coalesce("exact", "other")
    absent = (F.col("status") == "quote_absent") & ~any_scope(F.col("accession"))
    status = (
        F.when((F.col("status") == "no_quote") & F.coalesce(F.col("key_status") == "NEEDS_QUOTE", F.lit(False)), "awaiting_quote")
        .when(absent & holds.isNull(), "document_unavailable")
        .when(absent & holds, "split_across_chunks")
        .otherwise(F.col("status"))
    )
    return rows.withColumn("status", status).drop("exact", "other")


def unwritten(entries: DataFrame, truths: DataFrame) -> DataFrame:
    """Entries without any truth: negative controls are meant to have none, others are work outstanding."""
    bare = entries.join(truths.select("qid").distinct(), "qid", "left_anti")
    return bare.select("qid", F.when(F.col("type") == "negative_control", "negative_control").otherwise("ground_truth_unwritten").alias("status"))


def status_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count("*").alias("n"))
