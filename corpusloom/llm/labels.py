"""A bounded sample of labelled texts, fitting on it in one executor task, and held-out folds."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold, materialize, text_key, trimmed


def held_out(doc_id: Column, modulus: int, held: int) -> Column:
    """Rows whose labels are never learnt; a null id counts as held out."""
    return F.coalesce(fold(doc_id, modulus) == held, F.lit(True))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, characters: int) -> DataFrame:
    """A bounded sample of labelled texts from outside the held-out fold: place, text, label.

    Rows are taken by the hash of their id, at most ``most``, until their texts
    have ``characters`` characters; no text is left out or cut for its length.
    Both bounds hold for fitting alone, and bound the sides that are broadcast.
    Ids with contradicting labels or none are left out.
    """
    rows = labels.filter(~held_out(F.col("doc_id"), modulus, held)).groupBy("doc_id")
    rows = rows.agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other").select("doc_id", "label")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.select("doc_id", "key", F.length("text").alias("size")).join(F.broadcast(rows), "doc_id")
    sizes = sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(most)
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "key")  # at most ``most`` thin rows
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sizes.select("doc_id", "key", "label", F.row_number().over(order).alias("place"), before.alias("before")).filter(F.col("before") < characters)
    chosen = chosen.groupBy("doc_id", "key").agg(F.max("label").alias("label"), F.min("place").alias("place"), F.count("*").alias("copies"))
    found = texts.join(F.broadcast(materialize(chosen, "sample")), ["doc_id", "key"])
    return found.select("place", "text", F.col("label").cast("double").alias("label"))


def consumed(texts: list[str]) -> Iterator[str]:
    """The texts one by one; the list lets go of each."""
    for i, text in enumerate(texts):
        texts[i] = ""
        yield text


def fitted(sample: DataFrame, fit: Callable[[list[str], np.ndarray], dict]) -> dict:
    """What ``fit`` makes of the sample, in one task on an executor; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("place", "text", "label")), strict=True)), key=lambda r: r[:2])
        texts, label = [r[1] for r in rows], np.array([r[2] for r in rows], float)
        rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, label))], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(trimmed(run), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], np.zeros(0))
