"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / w``: ``u`` is a hash of its
id, ``w`` its quality weight. Within a source, complete epochs come first; the
rest of the budget goes to the documents of smallest key, whose sizes are
prefix-summed up to the budget. The document at the boundary is taken when that
brings the sum nearer to the budget.

The prefix sum is a radix descent, so no task sees a whole source: sums over
key ranges find the range the budget ends in, sums over its 1,024 subranges
narrow it, and only the rows left there are sorted. What comes out is one
cutoff key per source; each row decides for itself by comparing its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, materialize

SHARE, CAP, PATTERN, SEED = 1.5, 2, (5, 2, 1), "mix"
#: Marks that spoiled text is strewn with; each costs a document four times its share.
MARKS = "%*#$&|!"
_DIGITS = 2


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: what the share of stray marks leaves."""
    n = F.length(text)
    marks = n - F.length(F.translate(text, MARKS, ""))
    return F.greatest(F.lit(0.05), F.coalesce(1 - 4.0 * marks / F.nullif(n, F.lit(0)), F.lit(1.0)))


def order_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential key; 52 bits of an md5 make the uniform number."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(2**52))
    return -F.log(u) / weight


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, pattern: tuple[int, ...] = PATTERN) -> DataFrame:
    """``target`` of each (source, source_size): shares by weight, filled up to the caps.

    Sharing the excess out again by weight until no source is above its cap ends
    where every uncapped source has ``level * weight``; sorted by cap / weight the
    capped sources are a prefix, so running sums give the level directly. One row
    a source, whatever the number of documents.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(names) - 1) % len(pattern)
    weights = F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", weights).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.select(
        "source", "source_size", "weight", "cap",
        (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    rows = rows.withColumn("capped", F.col("cap") * F.col("open") <= F.col("weight") * F.col("left"))
    level = F.max(F.when(~F.col("capped"), F.col("left") / F.col("open"))).over(whole)
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def _digit(level: int) -> Column:
    """A digit of the key: its octave and sixteenth of it, then the 1,024th of that.

    Octaves suit keys of any weight: an exponential key falls in none of them
    with more than a quarter, so no pair of digits holds more than 0.002 % of
    the rows of one weight.
    """
    key = F.greatest("key", F.lit(1e-300))
    octave = F.floor(F.log2(key))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0) - 2.0**-40, key / F.pow(F.lit(2.0), octave) - 1)) * 16
    return (octave * 16 + F.floor(part)).cast("long") if level == 0 else F.floor((part - F.floor(part)) * 1024).cast("long")


def plan(rows: DataFrame, **rule) -> DataFrame:
    """One row a source: target, whole epochs and the cutoff (key, id) of the last one.

    ``rows``: doc_id, source, size, key. A source without words has target 0.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, **rule)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(goal, "goal")
    inside, rest = rows, goal.filter("budget > 0").select("source", "budget")
    for level in range(_DIGITS):
        inside = inside.withColumn("digit", _digit(level))
        sums = inside.groupBy("source", "digit").agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("until", F.sum("words").over(running))
        sums = sums.select(F.col("source").alias("s"), "digit", "words", "until").join(rest, F.col("s").eqNullSafe(F.col("source"))).drop("s")
        rest = sums.filter(F.col("until") >= F.col("budget")).groupBy("source").agg(
            F.min(F.struct("digit", (F.col("budget") - F.col("until") + F.col("words")).alias("budget"))).alias("at")
        )
        rest = materialize(rest.select("source", F.col("at.digit").alias("at"), F.col("at.budget").alias("budget")), f"digit{level}")
        here = rest.select(F.col("source").alias("s"), F.col("at"))
        inside = inside.join(here, F.col("source").eqNullSafe(F.col("s")) & (F.col("digit") == F.col("at"))).drop("s", "at", "digit")
        rest = rest.select("source", "budget")
    order = Window.partitionBy("source").orderBy("key", "doc_id")
    last = inside.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    last = last.join(rest.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("before") + F.col("size") / 2 <= F.col("budget")
    first_out = F.min(F.when(~taken, F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id")))).alias("stop")
    ends = last.groupBy("source").agg(first_out, F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))).alias("end"))
    ends = ends.select(F.col("source").alias("s"), "stop", "end", F.lit(True).alias("cut"))
    # written, so that its size is known and a source of any number of rows is joined where it lies
    return materialize(goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "budget"), "plan")


def taken() -> Column:
    """Words the mix takes of a row that its source's plan is joined to."""
    here = F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    again = F.when(F.col("stop").isNotNull(), here < F.col("stop")).otherwise(F.col("cut") & (here <= F.col("end")))
    return F.col("size") * (F.col("epochs") + F.coalesce(again, F.lit(False)).cast("long"))


def _key(weight: Column | None, seed: str) -> Column:
    return order_key(F.col("doc_id"), quality_weight(F.col("text")) if weight is None else weight, seed)


def with_key(docs: DataFrame, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size and sampling key of each row."""
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _key(weight, seed).alias("key"))


def mix(docs: DataFrame, seed: str = SEED, weight: Column | None = None, **rule) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and taken.

    ``weight`` is a positive column of ``docs``, such as a quality score; without
    it, :func:`quality_weight` serves. Null text has size 0 and is never taken;
    texts of any length are counted whole; a null source is a source of its own,
    ordered last; rows that repeat an id share its key and its fate (equal keys
    of different ids go by id); an empty table gives an empty result. Only
    doc_id, source and text are read, so clashing names among other columns
    don't matter.
    """
    rows = materialize(with_key(docs, seed, weight), "sizes")
    made = plan(rows, **rule)
    made = made.withColumnRenamed("source", "of")
    return rows.join(made, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def repeat(docs: DataFrame, seed: str = SEED, weight: Column | None = None, **rule) -> DataFrame:
    """The rows of the mix with all their columns, each as often as the mix takes it.

    Odd rows fare as in :func:`mix`; rows without words are not in the mix.
    """
    names = docs.columns
    sizes = materialize(with_key(docs, seed, weight), "sizes")
    made = plan(sizes, **rule)
    discard(sizes)
    made = made.select(F.struct("source", "epochs", "stop", "end", "cut").alias("_plan"))
    rows = docs.select(F.struct(*names).alias("_row"), size_of(F.col("text")).alias("size"), _key(weight, seed).alias("key"), F.col("doc_id"), F.col("source"))
    rows = rows.join(made, F.col("source").eqNullSafe(F.col("_plan.source")))
    rows = rows.select("_row", "size", "key", "doc_id", F.col("_plan.epochs").alias("epochs"), F.col("_plan.stop").alias("stop"), F.col("_plan.end").alias("end"), F.col("_plan.cut").alias("cut"))
    times = F.when(F.col("size") > 0, F.floor(taken() / F.col("size"))).otherwise(0).cast("int")
    return rows.select("_row", times.alias("times")).filter("times > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("_row.*")
