"""Removal of byte strings that occur more than once, by column-wise suffix sorting.

Every window of ``width`` bytes has an anchor: the leftmost of its 32-byte grams
of least hash. Equal windows have equal anchors at equal places, so windows are
brought together by anchor, as the runs of consecutive windows that share one.
A run is described by the hash of the content all its windows have in common;
only where that content occurs more than once can a window be repeated. Runs
that are equal as a whole are repeats at once.

Where different runs share their common content, their texts are sorted
column-wise: aligned at the anchor, the last column first, each round inserts
one symbol per document in front of its suffix; the order of the suffixes (the
rows of the collection's Burrows-Wheeler transform) is updated by one stable
sort on that symbol, and the common prefixes of neighbours by a range minimum.
Neighbours that share ``width`` symbols are repeated windows. The columns are
written to one sequential file and read once, from the last to the first.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import digests, halves, in_chunks, mix, prefixes
from .shared import materialize, parts, row_columns, texts_of

WIDTH, GRAM = 200, 32
_PIECE = 1 << 20
_POS = np.uint64(0xFFFFFFFF)


def runs(parts_: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: common (64-bit hash), whole (128-bit digest), doc, start, count, off.

    ``off`` is the anchor's distance from the run's start. Runs end in the middle
    of an anchor's reach, so that what their windows share is longer.
    """
    joined = b"".join(parts_)
    raw = np.frombuffer(joined, np.uint8)
    size = np.array([len(p) for p in parts_], np.int64)
    begin = np.cumsum(size) - size
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return np.zeros(0, np.uint64), np.zeros(0, "S16"), none, none, none, none
    sums, down = prefixes(raw)
    reach = width - gram + 1
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    windows = len(raw) - width + 1
    blocks = -(-len(key) // reach)
    padded = np.full(blocks * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    square = padded.reshape(blocks, reach)
    forth = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:windows], forth[reach - 1 : reach - 1 + windows]) & _POS).astype(np.int64)
    at = np.arange(windows)
    doc = np.searchsorted(begin, at, side="right") - 1
    valid = at + width <= begin[doc] + size[doc]
    half = (anchor - at) >= reach // 2
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (half[1:] != half[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, "S16"), none, none, none, none
    ends = np.cumsum(valid)
    stop = np.append(start[1:], windows)
    count = ends[stop - 1] - ends[start] + 1
    anchor, doc, half = anchor[start], doc[start], half[start]
    # what every window of this half must hold, whatever its run: from the nearest start to the nearest end
    low = anchor - np.where(half, reach // 2, 0)
    high = anchor + np.where(half, gram, width - reach // 2 + 1)
    span = lambda a, b: (sums[b] - sums[a]) * down[a]
    common = mix(span(low, high) ^ half.astype(np.uint64))
    off = anchor - start
    whole = digests(joined, start, start + count - 1 + width, off * 4096 + count)
    return common, whole, doc, start - begin[doc], count, off


def repeated(texts: list[bytes], off: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text, which of its windows occur in another one at the same distance from the anchor.

    Texts are different, and each is aligned at ``off``.
    """
    m = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    first, last = -off, size - off  # columns [first, last) relative to the anchor
    lo, hi = int(first.min()), int(last.max())
    base = np.cumsum(size - width + 1) - (size - width + 1)
    out = np.zeros(int((size - width + 1).sum()), bool)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    with tempfile.TemporaryFile() as spool:
        spool.truncate((hi - lo) * m)
        columns = np.memmap(spool, np.uint8, "r+", shape=(hi - lo, m))
        for i in range(0, m, 4096):
            j = min(m, i + 4096)
            place = np.arange(lo, hi)[:, None] + (begin + off)[None, i:j]
            columns[:, i:j] = raw[np.clip(place, 0, len(raw) - 1)]
        enter = np.argsort(-last, kind="stable")
        entered = 0
        order, shared = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for x in range(hi - 1, lo - 1, -1):
            symbols = columns[x - lo]
            k = entered
            while k < m and last[enter[k]] == x + 1:
                k += 1
            if k > entered:  # their suffix is empty so far and sorts first
                order = np.concatenate([enter[entered:k], order])
                shared = np.concatenate([np.zeros(k - entered, np.uint8), shared])
                shared[k - entered : k - entered + 1] = 0
                entered = k
            here = np.flatnonzero(first[order] <= x)
            if not len(here):
                order, shared = order[:0], shared[:0]
                continue
            sym = symbols[order[here]]
            by = here[np.argsort(sym, kind="stable")]
            sorted_ = symbols[order[by]]
            new = np.zeros(len(by), np.uint8)
            equal = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
            if len(equal):
                new[equal] = np.minimum(range_min(shared, by[equal - 1] + 1, by[equal]), width - 1) + 1
            order, shared = order[by], new
            full = shared >= width
            hit = full.copy()
            hit[:-1] |= full[1:]
            if hit.any():
                f = order[hit]
                out[base[f] + (x - first[f])] = True
        del columns
    return [out[b : b + n] for b, n in zip(base, size - width + 1, strict=True)]


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both included, for each pair, from a table of doubled ranges."""
    gap = high - low + 1
    result = values[low].copy()
    level, table = 0, values
    top = int(gap.max()).bit_length() - 1
    power = np.floor(np.log2(gap)).astype(np.int64)
    while True:
        mine = power == level
        if mine.any():
            a, b = low[mine], high[mine] - (1 << level) + 1
            result[mine] = np.minimum(table[a], table[b])
        if level == top:
            return result
        step = 1 << level
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
        level += 1


_SENT = "bucket int, common binary, whole binary, docs binary, starts binary, counts binary, offs binary, many binary, ids array<long>, keys array<long>"
_FOUND = "at long, key long, start int, count int, off int, common long, known boolean"


def _publisher(buckets: int, width: int):
    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SENT.split(", ")]
        kinds = [pa.int32(), *[pa.binary()] * 7, pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            ids, keys = batch.column("at").to_pylist(), batch.column("key").to_pylist()
            raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]
            pieces = [(i, a) for i, t in enumerate(raw) for a in range(0, len(t) - width + 1, _PIECE)]
            found = []
            for part in in_chunks([min(_PIECE, len(raw[i]) - a) for i, a in pieces], _PIECE):
                some = pieces[part]
                common, whole, doc, start, count, off = runs([raw[i][a : a + _PIECE + width - 1] for i, a in some], width)
                if len(doc):
                    at = np.array(some, np.int64)
                    found.append((common, whole, at[doc, 0], start + at[doc, 1], count, off))
            if not found:
                continue
            common, whole, doc, start, count, off = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((*halves(whole), common))
            common, whole, doc, start, count, off = (x[by] for x in (common, whole, doc, start, count, off))
            first = np.concatenate([[True], (common[1:] != common[:-1]) | (whole[1:] != whole[:-1])])
            many = np.zeros(len(first), bool)
            many[:-1] = first[:-1] & ~first[1:]
            home = np.array([i + k for i, k in zip(ids, keys, strict=True)], dtype=object) % buckets
            rows, bucket = [], np.where(first, (common % np.uint64(buckets)).astype(np.int64), home.astype(np.int64)[doc])
            for known in (False, True):  # copies beyond the first are repeats, as the marked first one is, and go by document
                keep = np.flatnonzero(first != known)
                keep = keep[np.argsort(bucket[keep], kind="stable")]
                if not len(keep):
                    continue
                at = bucket[keep]
                edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    k = keep[a:b]
                    used, place = np.unique(doc[k], return_inverse=True)
                    pack = lambda v, t: v[k].astype(t).tobytes()  # noqa: B023, E731
                    rows.append((int(at[a]), b"" if known else pack(common, np.uint64), b"" if known else pack(whole, "S16"), place.astype(np.int32).tobytes(), pack(start, np.int32), pack(count, np.int16), pack(off, np.int16), many[k].tobytes(), [ids[i] for i in used], [keys[i] for i in used]))
            for i in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 16], strict=True), kinds, strict=True)], names)

    return publish


def _emit(cols: list[np.ndarray], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids, keys, start, count, off, common = cols
    for i in range(0, len(ids), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(keys[s]), pa.array(start[s], pa.int32()), pa.array(count[s], pa.int32()), pa.array(off[s], pa.int32()), pa.array(common[s].view(np.int64)), pa.array(known[s])], ["at", "key", "start", "count", "off", "common", "known"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are repeats as a whole (known), and one of each different run whose common content is shared."""
    held = []
    for batch in batches:
        for common, whole, docs, starts, counts, offs, many, ids, keys in zip(*(batch.column(c).to_pylist() for c in ("common", "whole", "docs", "starts", "counts", "offs", "many", "ids", "keys")), strict=True):
            at = np.frombuffer(docs, np.int32)
            row = (np.array(ids, np.int64)[at], np.array(keys, np.int64)[at], np.frombuffer(starts, np.int32), np.frombuffer(counts, np.int16), np.frombuffer(offs, np.int16))
            if common:
                held.append((np.frombuffer(common, np.uint64), np.frombuffer(whole, "S16"), *row, np.frombuffer(many, bool)))
            else:
                zero = np.zeros(len(at), np.uint64)
                yield from _emit([*row, zero], np.ones(len(at), bool))
    if not held:
        return
    common, whole, ids, keys, start, count, off, many = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((*halves(whole), common))
    common, whole, ids, keys, start, count, off, many = (x[by] for x in (common, whole, ids, keys, start, count, off, many))
    first = np.concatenate([[True], (common[1:] != common[:-1]) | (whole[1:] != whole[:-1])])
    head = np.flatnonzero(first)
    n = np.diff(np.append(head, len(first)))
    full = np.repeat((n > 1) | np.logical_or.reduceat(many, head), n)
    group = np.concatenate([[True], common[1:] != common[:-1]])
    kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(group))
    length = np.diff(np.append(np.flatnonzero(group), len(group)))
    mixed = np.repeat((kinds > 1) & ~np.logical_and.reduceat(full, np.flatnonzero(group)), length)
    ask = mixed & first
    for keep, known in ((full, True), (ask & ~full, False)):
        yield from _emit([x[keep] for x in (ids, keys, start, count, off, np.where(ask, common, 0).astype(np.uint64))], np.full(int(keep.sum()), known))


def _fetch(width: int):
    """Texts of the runs that are asked for."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, key, text, asked in zip(batch.column("at").to_pylist(), batch.column("key").to_pylist(), texts_of(batch), batch.column("asked").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(a["common"], a["off"], a["known"], at, key, a["start"], raw[a["start"] : a["start"] + a["count"] - 1 + width]) for a in asked]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000], strict=True), kinds, strict=True)], ["common", "off", "known", "at", "key", "start", "bytes"])

    return fetch


def _sorter(width: int):
    """Windows repeated among the runs of this partition, as ranges of starts."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = {c: [] for c in ("off", "known", "at", "key", "start", "bytes")}
        for batch in batches:
            for c in cols:
                cols[c] += batch.column(c).to_pylist()
        if not cols["off"]:
            return
        found = repeated(cols["bytes"], np.array(cols["off"], np.int64), width)
        rows = []
        for known, at, key, start, hits in zip(cols["known"], cols["at"], cols["key"], cols["start"], found, strict=True):
            if known or not hits.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hits.view(np.int8), [0]])))
            rows += [(at, key, start + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50_000], strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["at", "key", "start", "count"])

    return sort


def _remover(width: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, copies, found in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("copies").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                if copies > 1 and len(raw) >= width:
                    spans = [[0, len(raw)]]
                else:
                    for f in found or []:
                        a, b = f["start"], f["start"] + f["count"] - 1 + width
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return remove


def suffix_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row.

    Removed is each byte covered by a string of ``width`` bytes that also starts
    elsewhere, in any document. Null text counts as empty; texts of any length
    are read whole; rows that repeat id and text are copies of each other like
    any; null ids are ids of their own; an empty table gives an empty result.
    Only doc_id and text are read, so names of other columns don't matter. Whole
    texts move once, by id.
    """
    texts = row_columns(docs)
    buckets = 2 * parts(docs)
    copies = texts.groupBy("at", "key").agg(F.count("*").alias("copies"), F.max("doc_id").alias("doc_id"))
    sent = texts.select("at", "key", "text").mapInArrow(_publisher(buckets, width), _SENT).repartitionById(buckets, "bucket")
    found = materialize(sent.mapInArrow(_resolve, _FOUND), "runs")
    asked = found.filter("common <> 0").groupBy("at", "key").agg(F.collect_list(F.struct("common", "off", "known", "start", "count")).alias("asked"))
    # both joins of the texts are on the same columns, so they read one exchange
    rows = texts.join(asked.hint("merge"), ["at", "key"]).select("at", "key", "text", "asked")
    rows = rows.mapInArrow(_fetch(width), "common long, off int, known boolean, at long, key long, start int, bytes binary")
    sorted_ = rows.repartition(buckets, "common").mapInArrow(_sorter(width), "at long, key long, start int, count int")
    ranges = found.filter("known").select("at", "key", "start", "count").unionByName(sorted_)
    listed = ranges.groupBy("at", "key").agg(F.array_sort(F.collect_set(F.struct("start", "count"))).alias("found"))
    side = copies.join(listed, ["at", "key"], "left")
    rows = texts.drop("doc_id").join(side.hint("merge"), ["at", "key"])
    made = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return rows.select("doc_id", "text", "copies", "found").mapInArrow(_remover(width), made)
