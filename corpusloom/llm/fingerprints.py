"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs: the lines of a text, long ones cut every 40 code points.
Eight paragraphs make a section. A section's digest is taken over its
paragraphs' digests, the root's over the sections'. The fingerprint is a string

    root (64 hex digits) : sections (8 each) : paragraphs (8 each)

so equal roots prove equal texts, differing sections and paragraphs locate
edits, and the share of common paragraphs is a likeness. Paragraphs restart at
each line break, so an insertion shifts no paragraph beyond its own line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, row_columns

PARAGRAPH, SECTION, WIDTH = 40, 8, 8


def paragraphs(text: Column) -> Column:
    """The leaves; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PARAGRAPH}}}+\\n?+|\\n"), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text; null counts as empty."""
    leaves = F.transform(paragraphs(F.coalesce(text, F.lit(""))), lambda p: F.sha2(p, 256))

    def tree(leaves: Column) -> Column:
        count = F.floor((F.size(leaves) + SECTION - 1) / SECTION).cast("int")
        starts = F.filter(F.sequence(F.lit(0), count), lambda i: i < count)
        sections = F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(leaves, i * SECTION + 1, SECTION), ""), 256))
        short = lambda xs: F.array_join(F.transform(xs, lambda x: F.left(x, F.lit(WIDTH))), "")
        return F.transform(F.array(sections), lambda s: F.concat(F.sha2(F.array_join(s, ""), 256), F.lit(":"), short(s), F.lit(":"), short(leaves)))[0]

    # a one-element transform binds the leaves once, where a plain column would be computed for each use
    return F.transform(F.array(leaves), tree)[0]


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def _leaves(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit(f".{{{WIDTH}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Share of common paragraphs of two fingerprints (Dice over distinct ones), 1 for equal roots."""
    shared = F.transform(F.array(F.struct(_leaves(a).alias("a"), _leaves(b).alias("b"))), lambda x: 2.0 * F.size(F.array_intersect(x["a"], x["b"])) / F.greatest(F.size(x["a"]) + F.size(x["b"]), F.lit(1)))[0]
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(shared)


def differing(a: Column, b: Column, level: str = "paragraphs") -> Column:
    """1-based places of ``a``'s branches (sections or paragraphs) that ``b`` has nowhere: where the edits are."""
    part = lambda x: F.regexp_extract_all(F.element_at(F.split(x, ":"), 2 if level == "sections" else 3), F.lit(f".{{{WIDTH}}}"), F.lit(0))
    return F.filter(F.transform(part(a), lambda x, i: F.when(~F.array_contains(part(b), x), i + 1)), lambda i: i.isNotNull())


def successors(ids: DataFrame) -> DataFrame:
    """Each distinct (doc_id, at, key) of ``ids`` with n_chars, copies and its follower's next_at, next_key.

    Ranges of the order are laid out first; a window then runs in each range,
    and only the first row of each range meets the others' (one row a range).
    """
    order = ["doc_id", "key"]
    spread = ids.groupBy("doc_id", "at", "key").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(spread.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    head = spread.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "at", "key")).alias("first"))
    head = head.select("range", F.struct("first.at", "first.key").alias("first"))
    whole = Window.orderBy("range")
    head = head.select("range", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    rows = spread.withColumn("next", F.lead(F.struct("at", "key")).over(inside))
    rows = rows.join(head, "range").withColumn("next", F.coalesce("next", "after"))
    return rows.select("doc_id", "at", "key", "n_chars", "copies", F.col("next.at").alias("next_at"), F.col("next.key").alias("next_key"))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and of its follower.

    The edited text's last quarter is the follower's beginning. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Null text counts as empty; null ids come first in the order;
    rows that repeat an id are ordered by their text's hash, and rows equal in
    both have one follower; an empty table gives an empty result. Whole texts
    move once (both joins read one exchange), a follower's beginning once more.
    """
    texts = row_columns(docs)
    after = materialize(successors(texts.select("doc_id", "at", "key", F.length("text").alias("n_chars"))), "successors")
    asks = after.select(F.col("doc_id").alias("of_id"), F.col("at").alias("of_at"), F.col("key").alias("of_key"), F.col("next_at").alias("at"), F.col("next_key").alias("key"), F.floor(F.col("n_chars") / 4).cast("int").alias("wanted"))
    gifts = texts.join(asks.hint("merge"), ["at", "key"])
    gifts = gifts.select(F.col("of_id").alias("doc_id"), F.col("of_at").alias("at"), F.col("of_key").alias("key"), F.left("text", F.col("wanted")).alias("gift"), fingerprint(F.col("text")).alias("next_fingerprint"))
    if not after.filter("copies > 1").isEmpty():  # else a repeated row would give twice
        gifts = gifts.dropDuplicates(["at", "key"])
    rows = texts.drop("doc_id").join(gifts.hint("merge"), ["at", "key"])
    n = F.length("text")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.left("text", (n - F.floor(n / 4)).cast("int")), "gift").alias("edited"), fingerprint(F.col("text")).alias("fingerprint"), "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
