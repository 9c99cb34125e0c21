"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes; where it falls below a threshold a chunk
ends, so boundaries follow content and an insertion moves only the chunks it
touches. Chunks are matched by digest. Runs of consecutive repeated chunks of
at least ``least`` bytes count as repeats; of each chunk the first occurrence
(by doc_id, then place) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import GEAR, digests, halves, in_chunks
from .shared import materialize, parts, text_key, texts_of

MEAN, LONGEST, LEAST = 40, 1024, 120
#: The operator's mean: a passage of 51 words seldom loses more than it can spare to its two boundary chunks.
FINE = 24
_CHUNK, _PAD = 2_000_000, 32
_G32 = (GEAR >> np.uint64(32)).astype(np.uint32)
_G32[0] = 0


def cuts(raw: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Places after which a chunk may end: gear hash below 2**32 / mean.

    The 32-bit gear hash of a place depends on its last 32 bytes; five doublings
    compute it for all places at once.
    """
    h = _G32[raw]
    for k in range(5):
        step = 1 << k
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(h < np.uint32(2**32 // mean)) + 1


def chunk(parts_: list[bytes], mean: int = MEAN, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest (128 bits), document, start and length of every chunk of the byte strings."""
    pad = bytes(_PAD)  # of gear value 0, so that no hash looks back into another document
    raw = np.frombuffer(pad + pad.join(parts_) + pad, np.uint8)
    size = np.array([len(p) for p in parts_], np.int64)
    begin = _PAD + np.concatenate([[0], np.cumsum(size[:-1] + _PAD)]) if len(size) else np.zeros(0, np.int64)
    end = cuts(raw, mean)
    doc = np.searchsorted(begin, end - 1, side="right") - 1
    inside = (doc >= 0) & (end <= begin[np.maximum(doc, 0)] + size[np.maximum(doc, 0)])
    end = np.unique(np.concatenate([end[inside], (begin + size)[size > 0]]))
    doc = np.searchsorted(begin, end - 1, side="right") - 1
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    start = np.maximum(start, begin[doc])
    pieces = -(-(end - start) // longest)  # where no boundary comes, a chunk ends by length
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        doc, low, high = np.repeat(doc, pieces), np.repeat(start, pieces) + nth * longest, np.repeat(end, pieces)
        start, end = low, np.minimum(low + longest, high)
    return digests(raw.tobytes(), start, end), doc, start - begin[doc], end - start


_SENT = "bucket int, digests binary, docs binary, starts binary, sizes binary, many binary, ids array<long>, keys array<long>"
_FLAG = "doc_id long, key long, start int, size int, later boolean"


def _publisher(buckets: int, mean: int, longest: int):
    """Chunks by bucket of their digest. Of a digest's copies within a batch the first
    travels (marked if there are more); the others are already known to be repeats and
    go by document, so that a line found everywhere makes no bucket large."""

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SENT.split(", ")]
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            texts = texts_of(batch)
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            seen, order = set(), sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i]))
            order = [i for i in order if (ids[i], keys[i]) not in seen and not seen.add((ids[i], keys[i]))]
            found = []
            for part in in_chunks([len(texts[i]) for i in order], _CHUNK):
                some = order[part]
                digest, doc, start, size = chunk([texts[i].encode("utf-8", "surrogatepass") for i in some], mean, longest)
                found.append((digest, np.array(some, np.int64)[doc] if len(doc) else doc, start, size))
            if not found:
                continue
            digest, doc, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
            low, high = halves(digest)
            by = np.lexsort((high, low))
            digest, doc, start, size = digest[by], doc[by], start[by], size[by]
            first = np.concatenate([[True], digest[1:] != digest[:-1]])[: len(digest)]
            many = np.zeros(len(digest), bool)
            many[:-1] = first[:-1] & ~first[1:]
            rows = []
            home = np.array([(i or 0) + k for i, k in zip(ids, keys, strict=True)], dtype=object) % buckets
            bucket = np.where(first, (low[by] % np.uint64(buckets)).astype(np.int64), home.astype(np.int64)[doc])
            for known in (False, True):
                keep = np.flatnonzero(first != known)
                keep = keep[np.argsort(bucket[keep], kind="stable")]
                if not len(keep):
                    continue
                at = bucket[keep]
                edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    k = keep[a:b]
                    used, place = np.unique(doc[k], return_inverse=True)
                    rows.append((int(at[a]), b"" if known else digest[k].tobytes(), place.astype(np.int32).tobytes(), start[k].astype(np.int32).tobytes(), size[k].astype(np.int32).tobytes(), many[k].tobytes(), [ids[i] for i in used], [keys[i] for i in used]))
            for i in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 16], strict=True), kinds, strict=True)], names)

    return publish


def _flags(ids: np.ndarray, none: np.ndarray, keys: np.ndarray, start: np.ndarray, size: np.ndarray, later: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(ids), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[s], pa.int64(), mask=none[s]), pa.array(keys[s]), pa.array(start[s], pa.int32()), pa.array(size[s], pa.int32()), pa.array(later[s])], ["doc_id", "key", "start", "size", "later"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated chunks of the buckets in this partition, and whether an earlier one exists."""
    held = []
    for batch in batches:
        for found, docs, starts, sizes, many, ids, keys in zip(*(batch.column(c).to_pylist() for c in ("digests", "docs", "starts", "sizes", "many", "ids", "keys")), strict=True):
            at = np.frombuffer(docs, np.int32)
            none = np.array([x is None for x in ids])[at]
            row = (np.array([x or 0 for x in ids], np.int64)[at], none, np.array(keys, np.int64)[at], np.frombuffer(starts, np.int32), np.frombuffer(sizes, np.int32))
            if found:
                held.append((np.frombuffer(found, "S16"), *row, np.frombuffer(many, bool)))
            else:
                yield from _flags(*row, np.ones(len(at), bool))
    if not held:
        return
    digest, ids, none, keys, start, size, many = (np.concatenate(x) for x in zip(*held, strict=True))
    low, high = halves(digest)
    by = np.lexsort((start, keys, ids, ~none, high, low))
    digest, ids, none, keys, start, size, many = (x[by] for x in (digest, ids, none, keys, start, size, many))
    same = np.concatenate([[False], (digest[1:] == digest[:-1]) & (ids[1:] == ids[:-1]) & (none[1:] == none[:-1]) & (keys[1:] == keys[:-1]) & (start[1:] == start[:-1])])
    if same.any():  # a row that is there twice is one document
        digest, ids, none, keys, start, size, many = (x[~same] for x in (digest, ids, none, keys, start, size, many))
    first = np.concatenate([[True], digest[1:] != digest[:-1]])
    head = np.flatnonzero(first)
    count = np.diff(np.append(head, len(digest)))
    keep = np.repeat(count > 1, count) | many
    yield from _flags(ids[keep], none[keep], keys[keep], start[keep], size[keep], ~first[keep])


def _cutter(least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, flags in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("flags").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs: list[list[tuple[int, int, bool]]] = []
                for f in flags or []:
                    item = (f["start"], f["start"] + f["size"], f["later"])
                    if runs and runs[-1][-1][1] == item[0]:
                        runs[-1].append(item)
                    else:
                        runs.append([item])
                runs = [r for r in runs if r[-1][1] - r[0][0] >= least]
                gone: list[tuple[int, int]] = []
                for r in runs:  # a lone chunk that also stands elsewhere is no reason to tear a first occurrence
                    for later, some in groupby(r, key=lambda x: x[2]):
                        part = list(some)
                        if later and part[-1][1] - part[0][0] >= least:
                            gone.append((part[0][0], part[-1][1]))
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((doc_id, len(raw), sum(r[-1][1] - r[0][0] for r in runs), sum(b - a for a, b in gone), len(runs), kept.hexdigest(), [{"start": r[0][0], "end": r[-1][1]} for r in runs]))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256", "spans"])

    return cut


def chunk_dedup(docs: DataFrame, mean: int = FINE, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256 and spans of every row.

    n_repeated counts the bytes of repeats wherever they stand, n_removed those
    of stretches of at least ``least`` bytes that stood earlier. Null text counts
    as empty; texts of any length are read whole; null ids come first in the
    order; rows that repeat id and text are one document and get equal results;
    an empty table gives an empty result. Only doc_id and text are read, so names
    of other columns don't matter.
    """
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    buckets = 2 * parts(docs)
    sent = texts.mapInArrow(_publisher(buckets, mean, longest), _SENT).repartitionById(buckets, "bucket")
    flags = materialize(sent.mapInArrow(_resolve, _FLAG), "flags")
    listed = flags.groupBy(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")).agg(F.array_sort(F.collect_set(F.struct("start", "size", "later"))).alias("flags"))
    rows = texts.join(listed, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    made = "doc_id long, n_bytes long, n_repeated long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return rows.select("doc_id", "text", "flags").mapInArrow(_cutter(least), made)
