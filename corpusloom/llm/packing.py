"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces of one length are interchangeable, so best fit runs over the histogram
of lengths (at most ``capacity`` numbers, whatever the input): lengths in
falling order, and for each the tightest open bins, found in a segment tree
over remaining capacities. Equal bins are handled in runs. The result is a
short table of assignments - ranks [from, to) of a length go to consecutive
bins from a first one, so many to a bin - that the pieces, numbered within
their length, are joined to.
"""

from __future__ import annotations

import array
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, slices, small_batches, text_key, texts_of, trim, trimmed

CAPACITY, END = 1024, 2
_PIECES = "doc_id long, key long, copy long, piece int, start long, length long, ids_crc32 long"
_LANES = 4096
#: Chunks whose ids a worker keeps (about 17 MB); bytes of the texts that are cut together.
_CHUNKS, _TEXTS = 1 << 17, 1 << 20
#: Where white space is doubled, chunks can't be told apart.
_DOUBLED = ("  ", " \n", "\n ", "\n\n")


class RoomTree:
    """Segment tree over remaining capacities: how many open bins have each."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of an open bin that holds ``need``."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Assignments (length, from_rank, to_rank, first_bin, per_bin, offset) of best-fit decreasing."""
    tree, open_, made, bins = RoomTree(capacity), defaultdict(deque), [], 0
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.tightest(length)
            if room is None:
                per = min(capacity // length, count - rank)
                first, run, room = bins, max(1, (count - rank) // per), capacity
                bins += run
            else:
                first, run = open_[room].popleft()
                per = min(room // length, count - rank)
                used = min(run, max(1, (count - rank) // per))
                tree.add(room, -used)
                if used < run:
                    open_[room].appendleft((first + used, run - used))
                run = used
            made.append((length, rank, rank + run * per, first, per, capacity - room))
            rank += run * per
            if left := room - per * length:
                open_[left].append((first, run))
                tree.add(left, run)
    return made


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary(dict):
    """Text chunks to their token ids as little-endian 32-bit numbers, learnt as they come.

    Ids are those of the tokenizer file. Where its merges rank as its ids do (as
    in byte-level vocabularies; a trial text confirms it), single chunks are
    encoded from the ranks, which takes a fraction of the time.
    """

    def __init__(self, path: str, most: int = _CHUNKS) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.ranks = Tokenizer.from_file(path), most, None
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = _byte_letters()
        try:
            import public_tokenizers
            import tiktoken

            ranks = {bytes(letters[c] for c in k): v for k, v in told["model"]["vocab"].items() if k not in self.special}
            made = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            trial = "It's a trial: 12,345 words\n\n  caf\u00e9, na\u00efve \u4f60\u597d \U0001f600 don't RE-DO x\u00b2"
            if made.encode_ordinary(trial) == self.tokenizer.encode(trial, add_special_tokens=False).ids:
                self.ranks = made
        except (ImportError, KeyError, ValueError):
            pass

    def __missing__(self, chunk: str) -> bytes:
        """Ids of what follows a space, or of a line's first chunk with the break before it."""
        if len(self) >= self.most:
            self.clear()
        self[chunk] = ids = self.whole(chunk if chunk[:1] == "\n" else " " + chunk)
        return ids

    def whole(self, text: str) -> bytes:
        return array.array("I", self.ranks.encode_ordinary(text) if self.ranks else self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a text. A byte-level BPE splits before every single space and line break,
        so chunks between them can be looked up; texts with other or doubled white space go whole."""
        if any(x in text for x in self.special):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if any(x in text for x in _DOUBLED) or not text.replace("\n", "").isprintable():
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


def cutter(path: str, capacity: int, end: int):
    """Batches of doc_id and text to their pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stop = Vocabulary(path), end.to_bytes(4, "little")
        trim()  # what reading the file took
        for batch in batches:
            for part in slices(batch.column("text"), _TEXTS):
                some, out = batch[part], []
                for doc_id, key, copy, text in zip(some.column("doc_id").to_pylist(), some.column("key").to_pylist(), some.column("copy").to_pylist(), texts_of(some), strict=True):
                    ids = words.ids(text) + stop
                    n, start = len(ids) // 4, 0
                    stops = range((n - 1) % capacity + 1, n + 1, capacity)
                    for piece, to in enumerate(stops):
                        out.append((doc_id, key, copy, piece, start, to - start, zlib.crc32(ids[4 * start : 4 * to])))
                        start = to
                columns = list(zip(*out, strict=True))
                names = ["doc_id", "key", "copy", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return cut


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most ``capacity`` ids; only the first of a longer document may be shorter."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("copy"), "text")
    return rows.mapInArrow(trimmed(cutter(path, capacity, end)), _PIECES)


def ranked(made: DataFrame, lanes: int = _LANES) -> DataFrame:
    """Pieces with their rank among those of their length.

    A length may hold most pieces, so ranks are counted in lanes (a hash of the
    document) and shifted by the lanes before: a table of lengths x lanes.
    """
    rows = made.withColumn("lane", F.pmod(F.xxhash64("doc_id", "key", "copy", "piece"), F.lit(lanes)))
    count = rows.groupBy("length", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "lane").orderBy("doc_id", "key", "copy", "piece")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    return rows.join(count, ["length", "lane"]).withColumn("rank", F.col("base") + F.col("place")).drop("lane", "base", "place")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, lanes: int = _LANES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null text counts as empty and makes a piece of one id; null and repeated
    ids are packed like any; an empty table gives an empty result. Only doc_id
    and text are read.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        made = materialize(pieces(docs, path, capacity, end), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = best_fit(histogram, capacity)
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "of long, low long, high long, first long, per long, base long")
    # a run's rows are found by the last run of its length that starts at or before the rank: arrays by length keep it one equi-join
    lists = plan.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "per", "base"))).alias("runs"))
    rows = ranked(made, lanes).join(F.broadcast(lists), F.col("length") == F.col("of"))  # at most capacity rows; their runs are as many as best_fit made
    rows = rows.select("*", F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0].alias("run"))
    place = F.col("rank") - F.col("run.low")
    inside = F.pmod(place, F.col("run.per"))
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first") + F.floor(place / F.col("run.per"))).alias("sequence_id"),
        (F.col("run.base") + inside * F.col("length")).alias("offset"),
    )
