"""Exact, near and substring deduplication against brute force."""

import hashlib
import itertools
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chunk_dedup, exact_dedup, hashing, ngram_join, shared, suffix_dedup
from corpusloom.llm.components import components
from corpusloom.llm.shared import materialize, text_key

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, at string, n long"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def frame(spark, rows):
    """doc_id and text, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", "l", "a", 1) for i, t in rows], SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[rng.integers(len(WORDS))]}{rng.integers(30)}" for _ in range(n))


def corpus():
    base, passage = prose(1, 300), prose(2, 80)
    rows = [(None, base), (None, "null id"), (7, None), (8, ""), (9, "x"), (10, "x"), (10, "x"), (11, " a  b\tc "), (12, " a b c ")]
    rows += [(20 + i, base) for i in range(6)]
    for i in range(40):  # near copies: a chain of edits and single edits
        words = base.split()
        for j in range(0, (i % 8) * 3, 3):
            words[(37 * (i + 1) + 11 * j) % len(words)] = f"edit{i}x{j}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, prose(50 + i, 120) + " " + passage + " " + prose(90 + i, 60)) for i in range(12)]
    rows += [(300, "Orre " * 900), (301, prose(3, 3)), (302, prose(3, 3).upper()), (303, "é" * 150 + "日本" * 90), (304, prose(77, 30000))]
    return rows


ROWS = corpus()


@pytest.mark.parametrize("how", [{}, {"block": 16}, {"block": 16, "digest": lambda *c: F.xxhash64(*c) % 7}, {"block": 3000, "digest": lambda *c: F.xxhash64(*c) % 2}])
def test_exact_groups(spark, how):
    """Small moduli force digests that different blocks share."""
    rows = ROWS if how.get("block", 4096) > 16 else [r for r in ROWS if r[0] != 304]
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    same = {}
    for i, t in norm:
        same.setdefault(t, []).append(i)
    want = Counter()
    for t, ids in same.items():
        known = [i for i in ids if i is not None]
        keep, first = (min(known) if known else None), True
        for i in ids:
            want[(i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest())] += 1
            first = first and i != keep
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(frame(spark, rows), **how).collect())
    assert got == want


def test_exact_rows_keep_their_columns(spark):
    kept = exact_dedup.keep_first(frame(spark, ROWS))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS})
    for op in (exact_dedup.exact_dedup, exact_dedup.keep_first):
        assert op(frame(spark, [])).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {k: min([x for x in v if x is not None], default=None) for k, v in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("small", [True, False])
def test_near_components(spark, small):
    """With and without broadcasts."""
    if not small:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = [r for r in ROWS if r[0] != 304]
    try:
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute(rows)


def test_many_in_one_list(spark):
    """A group of near copies of which some are linked only through others, and texts that share a passage without a link."""
    rng, base, passage = np.random.default_rng(3), prose(1000, 120).split(), prose(1001, 60)
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(len(words), rng.integers(1, 5), replace=False):
            words[at] = f"swap{i}at{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, passage + " " + prose(2000 + i, 20 + i % 25)) for i in range(400)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows)


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=40))
@settings(max_examples=40, deadline=None)
def test_sketches_never_differ_by_more_than_the_sets(base, other):
    a, b = (np.array(sorted(x), np.uint64) for x in (base, base ^ other))
    apart = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(ngram_join.sketch(a), ngram_join.sketch(b), strict=True))
    assert apart <= len(base ^ (base ^ other))


def test_boundary_of_similarity(spark):
    """Links at exactly 0.8, none just below, over small sets where light pairs are made."""
    rows = []
    for n in range(1, 34):
        base = [f"w{n}x{i}" for i in range(n + 4)]
        for cut in range(0, 5):
            rows.append((1000 * n + cut, " ".join(base[: len(base) - cut])))
        rows.append((1000 * n + 9, " ".join([*base, f"tail{n}", f"end{n}"])))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_near_keep_one(spark):
    rows = [r for r in ROWS if r[0] != 304]
    kept = ngram_join.keep_one(frame(spark, rows)).collect()
    want = brute(rows)
    groups = {c for i, n, c in want if n}
    assert len([r for r in kept if shingles(r["text"])]) == len(groups) and len([r for r in kept if not shingles(r["text"])]) == 2
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0 and ngram_join.near_duplicates(frame(spark, [(1, None), (2, "")])).count() == 2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[103] == got[100] == 100


def repeats(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                mask[i : i + width] = True
        out.append(mask)
    return out


def test_substrings(spark):
    rows = [r for r in ROWS if r[0] != 304]
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), t, mask in zip(rows, raw, repeats(raw, 200), strict=True):
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        starts = np.diff(np.concatenate([[0], mask.astype(int)])) == 1
        want[(i, len(t), int(mask.sum()), int(starts.sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    assert got == want
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_substrings_of_two_long_texts(spark):
    """Texts longer than a piece, and a repeated row."""
    long_ = prose(5, 200_000)
    rows = [(1, long_), (2, "start " + long_[700_000:1_300_000] + " end"), (3, prose(6, 100)), (4, "z" * 250), (4, "z" * 250)]
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert got[1]["n_removed"] in range(600_000, 600_003) and got[2]["n_removed"] == got[1]["n_removed"] and got[1]["n_spans"] == 1
    assert got[3]["n_removed"] == 0 and got[4]["n_removed"] == 250


@given(st.lists(st.text("ab", min_size=12, max_size=40), min_size=2, max_size=8, unique=True), st.integers(3, 8))
@settings(max_examples=60, deadline=None)
def test_column_wise_order(texts, width):
    texts = [t.encode() for t in texts]
    off = np.array([len(t) % 4 for t in texts])
    found = suffix_dedup.repeated(texts, off, width)
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            other = any(s - off[i] + off[j] >= 0 and u[s - off[i] + off[j] : s - off[i] + off[j] + width] == t[s : s + width] for j, u in enumerate(texts) if j != i)
            assert found[i][s] == other


@given(st.lists(st.integers(0, 255), min_size=1, max_size=60), st.data())
@settings(max_examples=60, deadline=None)
def test_range_minimum(values, data):
    values = np.array(values, np.uint8)
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(values) - 1), st.integers(0, len(values) - 1)), min_size=1, max_size=9))
    low, high = (np.array([f(p) for p in pairs]) for f in (min, max))
    assert suffix_dedup.range_min(values, low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]


def test_chunks_are_gear_chunks():
    raw = prose(9, 400).encode()
    h, ends = 0, []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(chunk_dedup._G32[b])) & 0xFFFFFFFF
        if h < 2**32 // 40:
            ends.append(i + 1)
    assert chunk_dedup.cuts(np.frombuffer(raw, np.uint8)).tolist() == ends
    digest, doc, start, size = chunk_dedup.chunk([raw, b"", raw[:50], b"\0" * 3000])
    assert sum(size) == len(raw) + 50 + 3000 and max(size) <= chunk_dedup.LONGEST and 1 not in doc
    shifted, *_ = chunk_dedup.chunk([b"inserted " + raw])
    assert len(set(shifted.tolist()) & set(digest[doc == 0].tolist())) >= len(digest[doc == 0]) - 6  # the first bytes have another past


def test_chunk_repeats(spark):
    rows = [r for r in ROWS if r[0] != 304]
    got = {}
    for r in chunk_dedup.chunk_dedup(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = {i: (t or "").encode() for i, t in rows}
    passage = len(prose(2, 80))
    for i in range(200, 212):
        (r,) = got[i]
        assert 0.7 * passage <= r["n_repeated"] <= 1.2 * passage and r["n_spans"] == 1
        assert (r["n_removed"] == 0) == (i == 200)
        if i == 200:
            assert r["kept_sha256"] == hashlib.sha256(texts[i]).hexdigest()
    assert got[301][0]["n_repeated"] == 0 and got[303][0]["n_repeated"] == 0 and got[7][0]["n_bytes"] == 0
    assert got[25][0]["n_removed"] == len(texts[25]) and got[None][0]["n_bytes"] in (len(texts[25]), 7)
    assert chunk_dedup.chunk_dedup(frame(spark, [])).count() == 0


def test_chunk_repeats_of_51_words(spark):
    rng = np.random.default_rng(51)

    def words(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 8))) for _ in range(n))

    rows = []
    for i in range(400):
        passage = words(51)
        rows += [(i + k, f"{words(40)} {passage} {words(40)}") for k in (0, 1000)]
    got = {r["doc_id"]: r for r in chunk_dedup.chunk_dedup(frame(spark, rows)).collect()}
    missed = [i for i in range(400) if not (got[i]["n_repeated"] and got[i + 1000]["n_repeated"] and got[i + 1000]["n_removed"])]
    assert len(missed) <= 8
    assert all(got[i]["n_removed"] == 0 for i in range(400))


def test_texts_that_collide_under_polynomials(spark):
    """The Thue-Morse string and its complement agree in any polynomial modulo 2**64; nothing may be removed for it."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    assert hashing.spans(np.frombuffer((one + two).encode(), np.uint8), np.array([0, 2048]), np.array([2048, 4096])).tolist()[0] == hashing.spans(np.frombuffer(two.encode(), np.uint8), np.array([0]), np.array([2048])).tolist()[0]
    assert len(set(hashing.digests((one + two).encode(), np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 2
    assert hashing.shingle_sets([one])[0].tolist() != hashing.shingle_sets([two])[0].tolist()


def plain_chunks(rows):
    """chunk_dedup's rows by its definition, over whole texts held in a dictionary of chunks."""
    texts = sorted({(i is not None, i or 0, t or "", i) for i, t in rows}, key=lambda r: (*r[:2], chunk_key(r[2])))
    cut, seen, count = {}, {}, Counter()
    for row in texts:
        raw, at, h = row[2].encode(), 0, 0
        for k, b in enumerate(raw):
            h = ((h << 1) + int(chunk_dedup._G32[b])) & 0xFFFFFFFF
            if h < 2**32 // chunk_dedup.FINE or k + 1 - at == chunk_dedup.LONGEST or k + 1 == len(raw):
                cut.setdefault(row, []).append((at, k + 1))
                count[raw[at : k + 1]] += 1
                seen.setdefault(raw[at : k + 1], (row, at))
                at = k + 1
    out = {}
    for row in texts:
        raw, runs = row[2].encode(), []
        for a, b in cut.get(row, []):
            if count[raw[a:b]] > 1:
                item = (a, b, seen[raw[a:b]] != (row, a))
                runs[-1].append(item) if runs and runs[-1][-1][1] == a else runs.append([item])
        runs = [r for r in runs if r[-1][1] - r[0][0] >= chunk_dedup.LEAST]
        gone = np.zeros(len(raw), bool)
        for r in runs:
            for later, some in itertools.groupby(r, key=lambda x: x[2]):
                part = list(some)
                if later and part[-1][1] - part[0][0] >= chunk_dedup.LEAST:
                    gone[part[0][0] : part[-1][1]] = True
        kept = hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
        out[(row[3], row[2])] = (row[3], len(raw), sum(r[-1][1] - r[0][0] for r in runs), int(gone.sum()), len(runs), kept)
    return Counter(out[(i, t or "")] for i, t in rows)


def test_chunks_by_their_definition(spark):
    rows = [r for r in ROWS if r[0] != 304 and "\0" not in (r[1] or "")]
    keys = {r["text"] or "": r["key"] for r in frame(spark, rows).select("text", text_key(F.col("text")).alias("key")).collect()}
    globals()["chunk_key"] = keys.__getitem__
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256")) for r in chunk_dedup.chunk_dedup(frame(spark, rows)).collect())
    assert got == plain_chunks(rows)


def test_shingle_sets_agree_with_their_definition():
    texts = ["", None or "", "one", "A b\tc\x0bd", "a B c d e", "a b c d e f a b c d e", "é Ü a b c d", prose(4, 50)]
    sets = hashing.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert hashing.set_id(sets[4]) == hashing.set_id(hashing.shingle_sets(["A  b C d\nE"])[0])


def test_sets_become_rows_piece_by_piece():
    sets = [np.arange(k, k + 100_000, dtype=np.int64) for k in range(60)]
    batch = pa.RecordBatch.from_pydict({"sid": list(range(60)), "whole": pa.array([s.tobytes() for s in sets], pa.binary())})
    total, rows = np.zeros(2, np.int64), 0
    tracemalloc.start()
    try:
        for out in ngram_join._entries(iter([batch])):
            total += [int(out.column(c).to_numpy().sum()) for c in ("h", "sid")]
            rows += out.num_rows
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 6_000_000 and total.tolist() == [sum(int(s.sum()) for s in sets), 100_000 * sum(range(60))]
    assert most < batch.nbytes


def test_sieve_lets_all_that_are_wanted_pass(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("nullif(id, 7) as doc_id", "id * 3 as key", "'x' as text")
    wanted = rows.filter("key % 40 = 0 or doc_id is null").selectExpr("doc_id as of_id", "key as of_key")
    for most, others in ((1 << 19, 200), (16, 4000)):
        monkeypatch.setattr(shared, "_WORDS", most)
        found = shared.sieve(rows, ["doc_id", "key"], wanted)
        assert found.columns == rows.columns
        keys = {r.key for r in found.collect()}
        assert {r.of_key for r in wanted.collect()} <= keys and len(keys) <= others
    assert shared.sieve(rows, ["doc_id", "key"], wanted.limit(0)).isEmpty()


def test_texts_without_near_copies_stay_where_they_lie(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.bytes(30).hex() for _ in range(300)) for _ in range(200)]
    texts += [t + " end" for t in texts[:5]]
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    written = lambda: sum(s.shuffleWriteBytes() for s in (found.apply(i) for found in [stages()] for i in range(found.size())))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {i: i - 200 if i >= 200 else i for i in range(205)}
    assert written() - before < sum(map(len, texts)) / 4
