"""Jaccard self-join over word shingles, size-aware with heavy and light sets.

Equal sets are one vertex. Two sets of similarity 0.8 share at least 0.8 of the
larger one, so under any common order of the shingles they share their first
``k`` common ones within ``size - ceil(0.8 size) + k`` places. With hashes as
the order and k a tenth of the size, each set publishes three tenths of its
shingles. A set that shares too few published shingles with others has no link.

The survivors count all their shingles, and those that share fewer than 0.8 of
them with other survivors go as well. What remains is ordered anew, rarest
first, and the same argument leaves a short prefix each. Light sets enumerate
the pairs (subsets of two) of their prefix; heavy sets scan the inverted lists
of theirs. The boundary is the prefix length at which enumerating becomes
dearer than scanning, from the sizes and list lengths found.

Members of a list meet only if their sizes, the shingles left behind their
places in both orders and 1,024-bit parity sketches of both sets allow a link;
each of these bounds is exact, so nothing is lost. A list (of a shingle, or of
a pair) is not expanded into all its pairs: first one member is compared with
the others, links are merged into components, and only lists that still hold
several components go on. There, members outside the list's largest component
are compared with those of other components, sixteen times as many each turn.
When each of them has had its turn, no link of the list can be missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, set_id, shingle_sets
from .shared import discard, keep_rows, materialize, parts, sieve, slices, small_batches, text_key, texts_of, trimmed

#: Links need 100 * intersection >= 80 * union.
NUM, DEN, WORDS = 80, 100, 5
#: Bytes of the texts that are hashed together, and of the sets that become rows together; published hashes that a task holds.
_CHUNK, _ENTRIES, _PUBLISH = 1_000_000, 1 << 23, 1 << 21
#: Words of a parity sketch; members that a list compares in its second turn, and by how much more in each further one.
SKETCH, REACH = 16, 16


def needed(n):
    """Least shingles that a set of n shares with any partner: ceil(0.8 n). Ints, arrays or columns."""
    return (NUM * n + DEN - 1) // DEN


def spare(n):
    """k of a set of n: a tenth, at least 1."""
    return (n + 9) // 10


def _needed(n: Column) -> Column:
    return F.floor((NUM * n + DEN - 1) / DEN)


def _test(n: Column) -> Column:
    """Published shingles that a set must share with others: k of its smallest possible partner."""
    return F.floor((_needed(n) + 9) / 10)


_SENT = "bucket int, hashes binary, owners binary, counts binary, ids array<long>, keys array<long>, ns array<long>, sids array<long>"
_SENT_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4]
_RESOLVED = "doc_id long, key long, n long, sid long, shared long"


def published(n: int) -> int:
    return n - needed(n) + spare(n)


def _publisher(buckets: int):
    """The texts' sets as one line each, and their published hashes by bucket. Within a chunk a
    hash travels once: those that several of its sets hold are counted here and sent as a mark (owner 0)."""
    names = [x.split()[0] for x in _SENT.split(", ")]

    def send(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), _SENT_TYPES, strict=True)], names)

    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        heads = list(held.values())
        owner = np.repeat(np.array(list(held), np.int64), [len(h) for h in heads])
        hashes = np.concatenate(heads)
        held.clear()
        del heads
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        length = np.diff(np.append(start, len(hashes)))
        who, count = np.unique(owner[np.repeat(length > 1, length)], return_counts=True)
        sent, by = hashes[start], np.where(length > 1, 0, owner[start])
        del hashes, owner, start, length
        bucket = (mix(sent) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((by, bucket))  # an owner is named once for its hashes in a bucket
        sent, by, bucket = sent[order], by[order], bucket[order]
        del order
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.flatnonzero(np.concatenate([[True], by[a + 1 : b] != by[a : b - 1]]))
            rows.append((int(bucket[a]), sent[a:b].tobytes(), by[a:b][at].tobytes(), np.diff(np.append(at, b - a)).astype(np.int32).tobytes(), None, None, None, None))
        if len(who):
            rows.append((int(who[0]) % buckets, None, who.tobytes(), count.astype(np.int64).tobytes(), None, None, None, None))
        yield from send(rows)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = turn = 0
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for part in slices(batch.column("text"), _CHUNK):
                sets = shingle_sets(texts_of(batch[part]), WORDS)
                sids = [set_id(s) if len(s) else None for s in sets]
                turn += 1
                yield from send([(turn % buckets, None, None, None, ids[part], keys[part], [len(s) for s in sets], sids)])
                for sid, s in zip(sids, sets, strict=True):
                    if sid is not None and sid not in held:
                        held[sid] = s[: published(len(s))].copy()
                        size += len(held[sid])
                if size >= _PUBLISH:
                    yield from flush(held)
                    size = 0
        if size:
            yield from flush(held)

    return publish


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of texts as they came; and how many hashes of this partition's buckets each set shares with another set."""
    hashes, owners, who, counts = [], [], [], []
    names = [x.split()[0] for x in _RESOLVED.split(", ")]
    for batch in batches:
        for h, o, c, *lines in zip(*(batch.column(x).to_pylist() for x in ("hashes", "owners", "counts", "ids", "keys", "ns", "sids")), strict=True):
            if lines[0] is not None:
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in lines], pa.nulls(len(lines[0]), pa.int64())], names)
            elif h is None:
                who.append(np.frombuffer(o, np.int64))
                counts.append(np.frombuffer(c, np.int64))
            else:
                hashes.append(np.frombuffer(h, np.uint64))
                owners.append(np.repeat(np.frombuffer(o, np.int64), np.frombuffer(c, np.int32)))
    if hashes:
        h, o = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) | (o == 0)  # copies of a set count once, each mark does
        h, o = h[new], o[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(start, len(h)))
        found = o[np.repeat(length > 1, length) & (o != 0)]
        a, b = np.unique(found, return_counts=True)
        who.append(a)
        counts.append(b)
    if who:
        a, at = np.unique(np.concatenate(who), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts).astype(float)).astype(np.int64)
        for i in range(0, len(a), 50_000):
            x, none = a[i : i + 50_000], pa.nulls(len(a[i : i + 50_000]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(x), pa.array(total[i : i + 50_000])], names)


def sketch(hashes: np.ndarray) -> list[int]:
    """Parities of the hashes in 1,024 places. Two sets that differ in d hashes differ in at most d parities."""
    parity = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, n, the whole set and its sketch for each text."""
    for batch in batches:
        for part in slices(batch.column("text"), _CHUNK):
            sets = shingle_sets(texts_of(batch[part]), WORDS)
            columns = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["sid", "n", "whole", "sketch"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles as rows."""
    for batch in batches:
        for part in slices(batch.column("whole"), _ENTRIES):
            sets = [np.frombuffer(x, np.int64) for x in batch.column("whole")[part].to_pylist()]
            sid = np.repeat(np.array(batch.column("sid")[part].to_pylist(), np.int64), [len(h) for h in sets])
            h = np.concatenate([*sets, np.zeros(0, np.int64)])
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (h, sid)], ["h", "sid"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("wa"), batch.column("wb"), strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(u) + len(v) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def rare_first(whole: DataFrame) -> DataFrame:
    """Of each vertex (sid, n, whole, sketch) that can have a link: sid, n, sketch, size, q, es and light.

    ``size`` counts the shingles that other vertices hold too; at least
    ``needed(n)`` of them must be there. ``q`` is the length of the prefix and
    ``es`` its shingles and one more, rarest first; light vertices enumerate the
    pairs of ``es``.
    """
    each = whole.select("sid", "whole").mapInArrow(trimmed(_entries), "h long, sid long")
    df = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = each.join(df, "h").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("es"))
    rows = shared.join(whole.select("sid", "n", "sketch"), "sid").withColumn("size", F.size("es")).filter(F.col("size") >= _needed(F.col("n")))
    rows = rows.withColumn("q", (F.col("size") - _needed(F.col("n")) + 1).cast("int"))
    # what scanning costs: each shingle's list is compared in as many turns as it doubles
    scan = F.aggregate(F.slice("es", F.lit(1), F.col("q")), F.lit(0.0), lambda a, e: a + 1 + F.log2(e["df"].cast("double")))
    es = F.transform(F.slice("es", F.lit(1), F.col("q") + 1), lambda e: e["h"])
    rows = materialize(rows.select("sid", "n", "sketch", "size", "q", scan.alias("scan"), es.alias("es")), "rare-first")
    # cost by prefix length, in powers of two (a few dozen rows): pairs to make, against lists to scan
    cost = rows.groupBy(F.ceil(F.log2(F.col("q").cast("double"))).alias("class")).agg(F.sum(F.col("q").cast("double") * (F.col("q") + 1) / 2).alias("light"), F.sum("scan").alias("heavy"))
    cost = cost.orderBy("class").collect()
    bound, best = -1, sum(r["heavy"] for r in cost)
    for i, r in enumerate(cost):
        total = sum(x["light"] for x in cost[: i + 1]) + sum(x["heavy"] for x in cost[i + 1 :])
        if total < best:
            bound, best = int(r["class"]), total
    # two shared shingles can be asked of sets that share two with every partner
    light = (F.col("n") >= 2) & (F.col("q") <= (2**bound if bound >= 0 else 0)) & (F.size("es") >= 2)
    made = rows.withColumn("light", light)
    made._corpusloom_folder = rows._corpusloom_folder
    return made


def entries(rows: DataFrame, *more: str) -> DataFrame:
    """List entries kind, key, sid, n, most, heavy of the vertices of :func:`rare_first`.

    All vertices are in the lists of their shingles (kind 0), where two light
    ones need not be compared; light ones are in the lists of their pairs (kind
    1). ``most`` is what a vertex can share at most with another one whose first
    common shingle (pair) this is.
    """
    heavy = (~F.col("light")).alias("heavy")
    single = rows.select("sid", "n", heavy, *more, "size", F.posexplode(F.slice("es", F.lit(1), F.col("q"))).alias("at", "key"))
    single = single.select(F.lit(0).alias("kind"), "key", "sid", "n", (F.col("size") - F.col("at")).alias("most"), "heavy", *more)
    # of the pair at i and j the places up to i and between i and j hold nothing in common
    pair = lambda x, i: F.transform(F.slice("es", i + 2, F.greatest(F.size("es") - i - 1, F.lit(0))), lambda y, j: F.struct(F.xxhash64(x, y).alias("key"), (F.col("size") - i - j).alias("most")))
    double = rows.filter("light").select("sid", "n", heavy, *more, F.explode(F.flatten(F.transform("es", pair))).alias("e"))
    return single.unionByName(double.select(F.lit(1).alias("kind"), "e.key", "sid", "n", "e.most", "heavy", *more))


def _may_link(na: str, nb: str, ma: str, mb: str) -> Column:
    """Bounds from the sizes and from what both can share at most from here on."""
    a, b = F.col(na), F.col(nb)
    sizes = DEN * F.least(a, b) >= NUM * F.greatest(a, b)
    return sizes & ((NUM + DEN) * F.least(F.col(ma), F.col(mb)) >= NUM * (a + b))


def _alike(na: str, nb: str, a: str, b: str) -> Column:
    """Bound from the sketches, whose words are the columns a0, a1, ... and b0, b1, ..."""
    apart = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))
    total = F.col(na) + F.col(nb)
    return (NUM + DEN) * (total - apart) >= 2 * NUM * total


def _words(name: str) -> list[Column]:
    return [F.element_at("sketch", i + 1).alias(f"{name}{i}") for i in range(SKETCH)]


def _similar(fit: DataFrame, whole: DataFrame, label: str) -> DataFrame:
    """Those of the written pairs (a, b) that are links.

    Where the pairs are few, the planner broadcasts them, so that only the sets
    they name are moved; else both joins shuffle.
    """
    left = whole.select(F.col("sid").alias("a"), F.col("whole").alias("wa"))
    right = whole.select(F.col("sid").alias("b"), F.col("whole").alias("wb")).join(fit.select("b").distinct(), "b", "left_semi")
    return materialize(left.join(fit, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(trimmed(_verify), "a long, b long"), label)


def _merge(labels: DataFrame | None, edges: DataFrame, label: str) -> DataFrame:
    """Labels (node, label) with more edges: components of the labels' graph, laid over them."""
    if labels is None:
        return components(edges)
    to = lambda df, c: df.join(labels.select(F.col("node").alias(c), F.col("label").alias("_l")), c, "left").withColumn(c, F.coalesce("_l", c)).drop("_l")
    fresh = components(to(to(edges, "a"), "b"))
    old = labels.join(fresh.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    new = fresh.join(labels.select("node"), "node", "left_anti").select("node", "label")
    made = materialize(old.unionByName(new), label)
    discard(fresh, labels)
    return made


def links(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """sid and label (component) of the vertices that have links.

    In the first turn each list compares its members with one hub, chosen by an
    aggregate, so a list of any length is never in one task. In later turns a
    member outside the largest component of its list is a hub once its place in
    the list (the list's length times a hash of the member) is within reach. A
    pair of a list that is never compared has a member that was no hub, so both
    are in the list's largest component.
    """
    place = F.shiftrightunsigned(F.xxhash64("sid", F.lit(7)), 12) / F.lit(float(1 << 52))
    each = entries(rows).withColumn("u", place)
    first = F.min(F.struct((~F.col("heavy")).alias("no"), "u", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"))).alias("f")
    chosen = each.groupBy("kind", "key").agg(F.count("*").alias("m"), first).filter("m > 1 and (kind = 1 or not f.no)").select("kind", "key", "m", "f.a", "f.na", "f.ma")
    pairs = each.join(chosen, ["kind", "key"]).filter((F.col("sid") != F.col("a")) & _may_link("n", "na", "most", "ma"))
    pairs = pairs.select(F.least("sid", "a").alias("a"), F.greatest("sid", "a").alias("b")).distinct()
    side = lambda c: rows.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), *_words(c))
    pairs = materialize(pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike("na", "nb", "a", "b")).select("a", "b"), "pairs")
    edges = _similar(pairs, whole, "links")
    labels = None if edges.isEmpty() else _merge(None, edges, "components")
    discard(pairs, edges)

    marked = rows.withColumn("label", F.col("sid")) if labels is None else rows.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    each = entries(marked, "label").withColumn("u", place)
    hub = F.min(F.struct((~F.col("heavy")).alias("no"), "u", "sid")).alias("f")
    open_ = each.groupBy("kind", "key").agg(F.count("*").alias("m"), hub, F.min("label").alias("l"), F.max("label").alias("h"))
    open_ = open_.filter("l < h and (kind = 1 or not f.no)").select("kind", "key", "m", F.col("f.sid").alias("hub"))
    state = each.join(open_, ["kind", "key"]).select("kind", "key", "sid", "n", "most", "heavy", "label", "u", "m", (F.col("sid") == F.col("hub")).alias("done"))
    state = state.join(rows.select("sid", *_words("a")), "sid")
    written, turn, reach = None, 0, REACH
    while True:
        sums = state.groupBy("kind", "key", "label").agg(F.count("*").alias("c"))
        major = sums.groupBy("kind", "key").agg(F.max_by("label", F.struct("c", "label")).alias("major"))
        state = state.join(major, ["kind", "key"]).withColumn("waits", ~F.col("done") & (F.col("label") != F.col("major"))).drop("major")
        live = state.groupBy("kind", "key").agg(F.max("waits").alias("any")).filter("any").select("kind", "key")
        state = materialize(state.join(live, ["kind", "key"], "left_semi"), f"state{turn}")
        discard(written)
        written = state
        if state.isEmpty():
            discard(state)
            break
        hubs = state.filter(F.col("waits") & (F.col("u") * F.col("m") < reach))
        hubs = hubs.select("kind", "key", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("most").alias("mx"), F.col("heavy").alias("hx"), F.col("label").alias("lx"), *[F.col(f"a{i}").alias(f"b{i}") for i in range(SKETCH)])
        meet = (F.col("label") != F.col("lx")) & (F.col("heavy") | F.col("hx") | (F.col("kind") == 1))
        pairs = state.join(hubs, ["kind", "key"]).filter(meet & _may_link("n", "nx", "most", "mx") & _alike("n", "nx", "a", "b"))
        pairs = materialize(pairs.select(F.least("sid", "x").alias("a"), F.greatest("sid", "x").alias("b")).distinct(), f"pairs{turn}")
        edges = _similar(pairs, whole, f"links{turn}") if not pairs.isEmpty() else pairs
        state = state.withColumn("done", F.col("done") | (F.col("waits") & (F.col("u") * F.col("m") < reach))).drop("waits")
        if not edges.isEmpty():
            labels = _merge(labels, edges, f"components{turn}")
            state = state.drop("label").join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        discard(pairs, edges)
        turn, reach = turn + 1, reach * REACH
    if labels is None:
        return rows.sparkSession.createDataFrame([], "sid long, label long")
    found = labels.select(F.col("node").alias("sid"), "label")
    found._corpusloom_folder = labels._corpusloom_folder
    return found


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, component_id, label (null without shingles), and rep_id and rep_key of the
    row that stands for the component. One row per row of ``docs``."""
    with small_batches(docs.sparkSession):
        return _near_groups(docs)


def _near_groups(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    buckets = 4 * parts(docs)
    found = texts.mapInArrow(trimmed(_publisher(buckets)), _SENT).repartitionById(buckets, "bucket").mapInArrow(trimmed(_resolve), _RESOLVED)
    found = materialize(found, "sets")
    rows = found.filter("shared is null").drop("shared")
    shared = found.filter("shared is not null").groupBy("sid").agg(F.sum("shared").alias("shared"))
    vertex = rows.filter("sid is not null").groupBy("sid").agg(F.max("n").alias("n"), F.min(F.struct("doc_id", "key")).alias("of"))
    live = vertex.join(shared, "sid").filter(F.col("shared") >= _test(F.col("n"))).select("of.doc_id", "of.key")
    live = materialize(live.withColumnsRenamed({"doc_id": "of_id", "key": "of_key"}), "survivors")
    # most texts go by a bounded filter where they lie, so only the survivors' can be moved
    chosen = sieve(texts, ["doc_id", "key"], live).join(live, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left_semi")
    whole = materialize(chosen.select("text").mapInArrow(trimmed(_whole), "sid long, n long, whole binary, sketch array<long>"), "whole")
    if not whole.groupBy("sid").count().filter("count > 1").isEmpty():  # rows that repeat both id and text
        once = materialize(whole.dropDuplicates(["sid"]), "once")
        discard(whole)
        whole = once
    rare = rare_first(whole)
    linked = links(rare, whole)
    made = rows.join(linked, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    made = materialize(made.select("doc_id", "key", "n", "label"), "labelled")
    discard(found, live, whole, rare, linked)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("k"))
    least = made.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(row).alias("rep"))
    out = made.join(least, "label", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("rep.id").alias("rep_id"), F.col("rep.k").alias("rep_key"), "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and empty texts have no shingles and are linked with nothing; ties and
    repeated rows fall in one component; null ids take part, but a component's
    id is its least id that is not null; an empty table gives an empty result.
    Texts of any length are read whole. Only doc_id and text are read, so names
    of other columns don't matter.
    """
    return near_groups(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component, and all those without shingles.

    The least id stands for a component (a null id only if there is no other,
    of rows that repeat id and text one); odd rows fare as in
    :func:`near_duplicates`, and all columns are kept whatever their names.
    """
    out = near_groups(docs)
    bare = F.col("label").isNull()
    stays = bare | (F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key")))
    verdicts = out.groupBy("doc_id", "key").agg(F.max(stays).alias("stays"), ((F.count("*") > 1) & ~F.max(bare)).alias("single"))
    return keep_rows(docs, text_key(F.col("text")), verdicts)
