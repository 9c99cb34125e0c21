"""Retrieval scores by question type, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import resolved

AT = (5, 20)
ANSWERABLE = ("single_fact", "period_over_period", "cross_company")


def _within(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, F.lit(False))


def _listed(hits: DataFrame, *names: str) -> DataFrame:
    """Each question's hits in one row, which any number of targets can be held against."""
    return hits.groupBy("qid").agg(F.collect_list(F.struct("rank", *names)).alias("_hits"))


def _best(hit) -> Column:
    """The best rank of the hits that ``hit`` is true of."""
    return F.array_min(F.transform(F.filter("_hits", hit), lambda h: h["rank"]))


def single_fact(hits: DataFrame, resolutions: DataFrame, at: tuple[int, ...] = AT) -> DataFrame:
    """qid, rank, recall_at_k, top1_correct, citation_correct and target_chunks; hits and resolutions are read once."""
    rows = resolutions.select("qid", "accession", "document", "chunk_ids").join(_listed(hits, "chunk_id", "accession", "document"), "qid", "left")
    cited = F.exists("_hits", lambda h: (h["rank"] == 1) & (h["accession"] == F.col("accession")) & h["document"].eqNullSafe(F.col("document")))
    rows = rows.groupBy("qid").agg(
        F.min(_best(lambda h: F.array_contains(F.col("chunk_ids"), h["chunk_id"]))).alias("rank"), F.max(cited).alias("citation_correct"),
        F.size(F.array_compact(F.array_distinct(F.flatten(F.collect_list("chunk_ids"))))).cast("long").alias("target_chunks"),
    )
    recall = [_within(F.col("rank"), k).alias(f"recall_at_{k}") for k in at]
    return rows.select("qid", "rank", *recall, _within(F.col("rank"), 1).alias("top1_correct"), F.coalesce("citation_correct", F.lit(False)).alias("citation_correct"), F.coalesce("target_chunks", F.lit(0)).alias("target_chunks"))


def coverage(hits: DataFrame, resolutions: DataFrame, by_accession: bool, at: tuple[int, ...] = AT) -> DataFrame:
    """Per question: whether every member was covered within k, and how many were.

    A member is covered by any chunk of its accession, or by one of its targets.
    Hits and resolutions are read once.
    """
    key = "accession" if by_accession else "chunk_id"
    rows = resolutions.select("qid", "member", "accession" if by_accession else "chunk_ids").join(_listed(hits, key), "qid", "left")
    meets = (lambda h: h[key] == F.col(key)) if by_accession else (lambda h: F.array_contains(F.col("chunk_ids"), h[key]))
    rows = rows.groupBy("qid", "member").agg(F.min(_best(meets)).alias("rank"), F.count("*").alias("times")).groupBy("qid")
    covered = lambda k: F.coalesce(F.sum(F.when(_within(F.col("rank"), k), F.col("times"))), F.lit(0))
    made = [f for k in at for f in (F.bool_and(_within(F.col("rank"), k)).alias(f"recall_at_{k}"), covered(k).cast("long").alias(f"covered_at_{k}"))]
    return rows.agg(*made, F.sum("times").alias("members_total"))


def target_recall(hits: DataFrame, resolutions: DataFrame, at: tuple[int, ...] = AT) -> DataFrame:
    """Coverage by target chunk, and whether it means anything: a quote that is spread over
    accessions, or a target text that others repeat, makes chunk identity incidental."""
    worth = resolutions.groupBy("qid").agg(F.max(F.greatest(F.coalesce("corpus_accessions", F.lit(1)), F.lit(1))).alias("max_corpus_accessions"), F.max(F.greatest(F.coalesce("duplicate_text_count", F.lit(1)), F.lit(1))).alias("max_duplicate_text_count"))
    reason = F.when(F.col("max_corpus_accessions") > 1, F.format_string("the quote occurs in %d accessions", F.col("max_corpus_accessions"))).when(F.col("max_duplicate_text_count") > 1, F.format_string("a target's text occurs in %d chunks", F.col("max_duplicate_text_count")))
    return coverage(hits, resolutions, False, at).join(worth.withColumn("not_meaningful_because", reason), "qid").withColumn("meaningful", F.col("not_meaningful_because").isNull())


def section_result(hits: DataFrame, resolutions: DataFrame, tickers: list[str]) -> DataFrame:
    """Whether the first hit's section is one of its targets'; questions of other tickers are left out."""
    fit = resolutions.filter(F.col("ticker").isin(tickers) & (F.size("sections") > 0))
    fit = fit.groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sections")))).alias("expected"))
    top = hits.filter("rank = 1").select("qid", F.coalesce("section", F.lit("None")).alias("observed"))
    return fit.join(top, "qid").withColumn("correct", F.array_contains("expected", F.col("observed")))


def dedup_over_hits(hits: DataFrame, top: int = 20) -> DataFrame:
    """Distinct accessions and raw texts among each question's hits."""
    rows = hits.filter(F.col("rank") <= top).groupBy("qid")
    rows = rows.agg(F.count("*").alias("hits"), F.countDistinct("accession").alias("distinct_accessions"), F.countDistinct("text").alias("distinct_texts"), F.array_sort(F.collect_set("ticker")).alias("tickers"))
    return rows.withColumn("ratio", F.round(F.col("distinct_accessions") / F.nullif("distinct_texts", F.lit(0)), 2))


def recall_by_type(scored: DataFrame, at: tuple[int, ...] = AT) -> DataFrame:
    """Means by type of the boolean scores of ``scored`` (type, recall_at_k, ...)."""
    flags = [c for c, kind in scored.dtypes if kind == "boolean"]
    return scored.groupBy("type").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("int")), 4).alias(c) for c in flags])


def score_stats(values: DataFrame) -> DataFrame:
    """n, min, median and max of ``score`` by ``kind``, rounded, with the scores from the top."""
    return values.groupBy("kind").agg(
        F.count("score").alias("n"), F.round(F.min("score"), 4).alias("min"), F.round(F.median("score"), 4).alias("median"), F.round(F.max("score"), 4).alias("max"),
        F.sort_array(F.collect_list(F.round("score", 4)), asc=False).alias("scores"),
    )


def headline(values: DataFrame) -> DataFrame:
    """Separation of the medians of answerable and negative first scores, and whether they overlap."""
    of = lambda kind: F.when(F.col("kind") == kind, F.col("score"))
    a, n = of("answerable"), of("negative")
    rows = values.agg(F.round(F.median(a), 4).alias("answerable_median"), F.round(F.median(n), 4).alias("negative_median"), F.min(a).alias("low"), F.max(n).alias("high"))
    return rows.select("answerable_median", "negative_median", F.round(F.col("answerable_median") - F.col("negative_median"), 4).alias("median_separation"), F.round("low", 4).alias("lowest_answerable"), F.round("high", 4).alias("highest_negative"), F.coalesce(F.col("low") <= F.col("high"), F.lit(False)).alias("distributions_overlap"))


def only(rows: DataFrame, ids: list[str] | None) -> DataFrame:
    """Rows of the questions ``ids`` (all of them without a list); a name the key lacks is simply absent."""
    return rows if ids is None else rows.filter(F.col("qid").isin(ids))


def evaluate(entries: DataFrame, hits: DataFrame, resolutions: DataFrame, at: tuple[int, ...] = AT, answerable: tuple[str, ...] = ANSWERABLE, section_tickers: list[str] | None = None) -> dict[str, DataFrame]:
    """All parts of a report. ``entries``: qid, type, question; those without a question are rejected."""
    live = entries.filter(F.coalesce("question", F.lit("")) != "")
    of = lambda kind: resolutions.join(live.filter(F.col("type") == kind).select("qid"), "qid", "left_semi")
    single = single_fact(hits, of("single_fact"), at).withColumn("type", F.lit("single_fact"))
    cross = coverage(hits, of("cross_company"), False, at).withColumn("type", F.lit("cross_company"))
    period = coverage(hits, of("period_over_period"), True, at).withColumn("type", F.lit("period_over_period"))
    recall = [*[f"recall_at_{k}" for k in at]]
    every = single.select("type", *recall).unionByName(cross.select("type", *recall)).unionByName(period.select("type", *recall))
    first = hits.filter("rank = 1").join(live, "qid").select("score", F.when(F.col("type") == "negative_control", "negative").when(F.col("type").isin(*answerable), "answerable").alias("kind"))
    section = section_result(hits, of("single_fact").unionByName(of("cross_company")), section_tickers or [])
    return {
        "rejected": entries.filter(F.coalesce("question", F.lit("")) == ""),
        "unresolved": resolutions.filter(~resolved(F.col("status"))).select("qid", "member", "accession", "status"),
        "single_fact": single, "cross_company": cross, "period_over_period": period,
        "target_recall": target_recall(hits, of("period_over_period"), at),
        "dedup": dedup_over_hits(hits.join(live.filter("type = 'dedup_diagnostic'").select("qid"), "qid", "left_semi")),
        "by_type": recall_by_type(every, at), "stats": score_stats(first.filter("kind is not null")), "headline": headline(first),
        "section_accuracy": section.agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy")),
    }
