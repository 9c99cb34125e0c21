"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of fixed size; equal blocks get equal
integer names, then adjacent pairs of names are named again, level by level,
until one name is left: the document's identity. Names never collide: the
blocks (pairs) are sorted under a 64-bit digest, and where a digest holds more
than one distinct block the name also carries the block's rank among them. The
sort is a grouped minimum and maximum, so copies are merged before the shuffle
and no block is ever compared with all its copies.

Only sorting moves text. Names themselves are computed beside the text, with a
join against the ranks only if a digest is shared by different blocks at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, keep_rows, materialize, text_key

BLOCK = 4096
Digest = Callable[..., Column]


def normalise(text: Column) -> Column:
    """Null as empty, runs of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _ranks(items: DataFrame, label: str) -> DataFrame | None:
    """(digest, item, rank) of digests that several distinct items share; None if there are none.

    ``items``: digest, item. The common case costs one pre-aggregated shuffle.
    """
    shared = items.groupBy("digest").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).filter("lo < hi").select("digest")
    shared = materialize(shared, f"{label}-shared")
    if shared.isEmpty():
        return None
    distinct = items.join(shared, "digest", "left_semi").groupBy("digest", "item").agg(F.count("*").alias("n"))
    listed = distinct.groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("all"))
    return materialize(listed.select("digest", F.posexplode("all").alias("rank", "item")), label)


def _named(rows: DataFrame, level: str, digest: Digest) -> DataFrame:
    """``rows`` (doc_id, key, items) with the items' names: structs of digest and rank."""
    each = F.transform("items", lambda x: digest(x))
    ranks = _ranks(rows.select(F.explode("items").alias("item")).select(digest(F.col("item")).alias("digest"), "item"), level)
    if ranks is None:
        return rows.select("doc_id", "key", F.transform(each, lambda d: F.struct(d.alias("digest"), F.lit(0).alias("rank"))).alias("names"))
    placed = rows.select("doc_id", "key", F.posexplode_outer("items").alias("at", "item")).withColumn("digest", digest(F.col("item")))
    placed = placed.join(ranks, ["digest", "item"], "left")
    name = F.when(F.col("at").isNotNull(), F.struct("at", F.struct("digest", F.coalesce("rank", F.lit(0)).alias("rank")).alias("name")))
    listed = placed.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(name)).alias("named"))
    return listed.select("doc_id", "key", F.transform("named", lambda x: x["name"]).alias("names"))


def identities(docs: DataFrame, block: int = BLOCK, digest: Digest = F.xxhash64) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, key, copies, text_sha256, n_blocks, name.

    Two rows have the same (n_blocks, name) exactly if their normalised texts
    are equal. An empty text has no blocks and the name null.
    """
    texts = docs.select("doc_id", normalise(F.col("text")).alias("text")).withColumn("key", text_key(F.col("text")))
    cut = texts.select("doc_id", "key", "text", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("items"))
    rows = cut.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"), F.size("items").alias("n_blocks"))
    rows = rows.groupBy("doc_id", "key", "n_blocks", "text_sha256").agg(F.count("*").alias("copies"))
    names = materialize(_named(cut.select("doc_id", "key", "items"), "blocks", digest), "names0")
    done = []
    level = 0
    while True:
        done.append(names.filter(F.size("names") <= 1).select("doc_id", "key", F.try_element_at("names", F.lit(1)).alias("name")))
        open_ = names.filter(F.size("names") > 1)
        if open_.isEmpty():
            break
        level += 1
        last = F.struct(F.lit(0).cast("long").alias("digest"), F.lit(-1).alias("rank"))
        pair = lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), last).alias("b"))
        pairs = open_.select("doc_id", "key", F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), pair).alias("items"))
        names = materialize(_named(pairs, f"pairs{level}", digest), f"names{level}")
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    named = named.groupBy("doc_id", "key").agg(F.first("name", ignorenulls=True).alias("name"))
    return rows.join(named, rows["doc_id"].eqNullSafe(named["doc_id"]) & (rows["key"] == named["key"])).select(rows["doc_id"], rows["key"], "copies", "text_sha256", "n_blocks", "name")


def groups(docs: DataFrame, **how) -> DataFrame:
    """Identities with keep_id and group_size: one row per distinct (doc_id, text)."""
    rows = materialize(identities(docs, **how), "identities")
    same = rows.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    same = same.select(F.col("n_blocks").alias("n"), F.col("name").alias("as"), "keep_id", "group_size")
    return rows.join(same, (F.col("n_blocks") == F.col("n")) & F.col("name").eqNullSafe(F.col("as"))).drop("n", "as")


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays; null ids only stay if the group
    has no other, and of rows that repeat both id and text one stays. Null text
    counts as empty. An empty table gives an empty result; only doc_id and text
    are read.
    """
    rows = groups(docs, **how)
    each = rows.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; odd rows fare as in :func:`exact_dedup`."""
    verdicts = groups(docs, **how).select("doc_id", "key", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"), (F.col("copies") > 1).alias("single"))
    return keep_rows(docs, text_key(normalise(F.col("text"))), verdicts)
