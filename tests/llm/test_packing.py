"""Packing, mixing, fingerprints, archives and the pipeline."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints, mixing, packing, warc
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.shared import materialize, small_batches


def frame(spark, rows, columns="doc_id long, text string, source string, size string, key string, length string"):
    return spark.createDataFrame([(i, t, s, "a", "b", "c") for i, t, s in rows], columns)


ODD = [(None, "null id", None), (1, None, "a"), (2, "", "a"), (3, "x y", "b"), (3, "x y", "b"), (4, "long word " * 3000, "b"), (5, "  two  spaces\n\nit's <|endoftext|> \tend ", None), (6, "é日\U0001f600", "c")]


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(capacity - n)
    return sorted(room)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=80))
@settings(max_examples=120, deadline=None)
def test_runs_are_best_fit_decreasing(lengths):
    made = packing.best_fit(Counter(lengths), 30)
    held, seen = defaultdict(list), Counter()
    for length, low, high, first, per, base in made:
        for r in range(low, high):
            held[first + (r - low) // per].append((base + (r - low) % per * length, length))
            seen[length] += 1
    assert seen == Counter(lengths)
    for items in held.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 30
    assert sorted(30 - sum(n for _, n in x) for x in held.values()) == plain_best_fit(lengths, 30)


def test_packing_of_odd_rows(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t, _ in ODD:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cut = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    rows = packing.pack(frame(spark, ODD), vocabulary()).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        assert [o for o, _ in sorted(items)] == np.cumsum([0, *[n for _, n in sorted(items)]])[:-1].tolist() and sum(n for _, n in items) <= 1024
    assert len(bins) == len(plain_best_fit([r["length"] for r in rows], 1024))
    assert packing.pack(frame(spark, []), vocabulary()).count() == 0


def test_batches_end_at_their_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('x', if(id = 5, 9000000, 2000)) as text")
    with small_batches(spark):
        found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert spark.conf.get(name, None) is None
    assert sum(r.rows for r in found) == 6000 and sum(r.bytes > 9_000_000 for r in found) == 1
    assert sorted(r.bytes for r in found)[-2] < 5_000_000
    spark.conf.set(name, "1000000")
    try:
        with small_batches(spark):
            assert spark.conf.get(name) == "1000000"
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)


def test_cutting_holds_little_beside_the_texts():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:06x}" for x in rng.integers(0, 1 << 24, 200)) for _ in range(4000)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4002)), "key": [0] * 4002, "copy": [0] * 4002, "text": texts})
    tracemalloc.start()
    try:
        made = [r for out in packing.cutter(vocabulary(), 1024, 2)(iter([batch])) for r in zip(out.column("doc_id").to_pylist(), out.column("piece").to_pylist(), strict=True)]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {i for i, _ in made} == set(range(4002)) and len(set(made)) == len(made)
    assert most < 60_000_000


@given(st.text(st.sampled_from(list("ab .,'\n\t é²日 x1")), max_size=30))
@settings(max_examples=200, deadline=None)
def test_chunked_ids_are_the_tokenizers(text):
    words = packing.Vocabulary(vocabulary()) if not hasattr(test_chunked_ids_are_the_tokenizers, "w") else test_chunked_ids_are_the_tokenizers.w
    test_chunked_ids_are_the_tokenizers.w = words
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def shared_out(sizes, pattern=(5, 2, 1)):
    """Targets by sharing the excess out again and again."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: pattern[i % 3] for i, s in enumerate(names)}
    goal, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s, x in share.items():
            goal[s] += x
            if goal[s] >= 2 * sizes[s]:
                left += goal[s] - 2 * sizes[s]
                goal[s] = 2.0 * sizes[s]
        open_ = {s for s in open_ if goal[s] < 2 * sizes[s]}
    return goal


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = ODD + [(100 + i, "w " * int(rng.integers(1, 40)), f"s{int(i**0.5) % 9}" if i % 11 else None) for i in range(600)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert got and sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(3)).collect()))
    sizes, source = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
        source[(i, len((t or "").split()))].append(s)
    goal, taken = shared_out(dict(sizes)), defaultdict(int)
    for r in got:
        (s,) = set(source[(r["doc_id"], r["size"])])
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    largest = defaultdict(int)
    for i, t, s in rows:
        largest[s] = max(largest[s], len((t or "").split()))
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in goal)
    repeated = Counter((r["doc_id"], r["text"]) for r in mixing.repeat(frame(spark, rows)).collect())
    assert sum(len(t.split()) * n for (_, t), n in repeated.items()) == sum(taken.values())
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [(1, None, None)])).first()["taken"] == 0


def test_weights_decide(spark):
    """Spoiled texts of a source that is taken in part are taken less often."""
    rows = [(i, ("wo%%%rd " if i % 2 else "word ") * 20, "a") for i in range(400)] + [(1000 + i, "w " * 40, f"b{i}") for i in range(2)]
    rows = [(i, t, {"a": "c"}.get(s, s)) for i, t, s in rows]  # third by code point: weight 1
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(frame(spark, rows)).collect()}
    assert sum(got[i] for i in range(0, 400, 2)) > 1.1 * sum(got[i] for i in range(1, 400, 2))


def test_fingerprints(spark):
    rows = [(None, "null id\nx", "s"), (1, None, "s"), (2, "", "s"), (3, "a" * 100 + "\nb" * 9, "s"), (3, "other text of the id", "s"), (4, "same\n" * 40 + "tail", "s"), (5, "same\n" * 40 + "tail", "s"), (7, "日本語" * 70, "s"), (-4, "first", "s"), (9, "dup", "s"), (9, "dup", "s")]
    got = fingerprints.edits(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    order = [(None, "null id\nx"), (-4, "first"), (1, ""), (2, "")]
    three = [t for i, t, _ in rows if i == 3]
    for threes in (three, three[::-1]):  # rows of one id follow each other by hash
        seq = order + [(3, t) for t in threes] + [(4, rows[5][1]), (5, rows[6][1]), (7, rows[7][1]), (9, "dup")]
        edited = {}
        for (i, t), (_, u) in zip(seq, seq[1:] + seq[:1], strict=True):
            m = len(t) // 4
            edited[(i, len(t))] = hashlib.sha256((t[: len(t) - m] + u[:m]).encode()).hexdigest()
        if all(by[k]["edited_sha256"] == v for k, v in edited.items()):
            break
    else:
        raise AssertionError("edited texts")
    same = {r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}
    assert len(same) == 1 and by[(1, 0)]["fingerprint"] == by[(2, 0)]["fingerprint"] and len({r["fingerprint"] for r in got}) == len({t or "" for _, t, _ in rows})
    assert by[(4, 204)]["near_next"] == 1.0 and by[(1, 0)]["near_edited"] == 1.0 and 0.5 < by[(7, 210)]["near_edited"] < 1 and by[(7, 210)]["near_next"] == 0
    assert fingerprints.edits(frame(spark, [])).count() == 0 and fingerprints.edits(frame(spark, rows[:1])).first()["near_next"] == 1.0


def test_differing_branches(spark):
    a, b = "\n".join(f"paragraph {i}" for i in range(30)), "\n".join(f"paragraph {i}" if i != 17 else "edited" for i in range(30))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    got = row.select(fingerprints.differing(F.col("a"), F.col("b")).alias("p"), fingerprints.differing(F.col("a"), F.col("b"), "sections").alias("s")).first()
    assert got["p"] == [18] and got["s"] == [3]
    leaves = spark.createDataFrame([(a + "\n\n" + "x" * 99,)], "t string").select(fingerprints.paragraphs(F.col("t")).alias("p")).first()["p"]
    assert "".join(leaves) == a + "\n\n" + "x" * 99 and max(map(len, leaves)) <= fingerprints.PARAGRAPH + 1


PAGES = [(1, "http://a/\r\nX: y", "p" * 2000), (5, None, "p" * 2000), (3, "u", "p" * 2000), (4, "u", None), (6, "u", ""), (7, "u", "q" * 999), (8, "u", "q" * 999), (None, "u", "r" * 1500), (9, "u", "r" * 1500), (10, "é", "日" * 500), (11, "u", "s" * 1200), (11, "u", "s" * 1200)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in PAGES], "page_id long, url string, html string, digest string")
    bundles = warc.archive(pages, frame=3000, bundle=6000).cache()
    got = warc.records(bundles).collect()
    want = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        keep = max([p for p, _, g in PAGES if (g or "") == (h or "") and p is not None], default=None)
        again = len(raw) >= 1000 and keep is not None and keep != i
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keep if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    row = bundles.first()
    reader = warc.Reader(bytes(row["data"]))
    ident, number, offset, length = reader.index()[-1]
    assert reader.get(ident) == reader.frame(number)[offset : offset + length] and reader.get("absent") is None
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(bytes(row["data"]), read_across_frames=True).read() for _ in range(1))
    assert whole == b"".join(reader.frame(n) for n in range(len(reader.at) - 1))
    assert all("\r" not in (r["record_id"] or "") for r in got)
    files = [r["path"] for r in warc.export(bundles, str(tmp_path)).collect()]
    again = warc.records(warc.read_files(spark, str(tmp_path / "*.warc.zst")))
    assert len(files) == bundles.count() and again.count() == len(PAGES)
    with pytest.raises(ValueError):
        warc.Reader(bytes(row["data"])[:-1])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_every_record_is_found_by_its_id(spark):
    """Rows that repeat a page and rows without an id have records, ids and references of their own."""
    odd = [*PAGES, (11, "v", "s" * 1200), (11, "v", "t" * 1300), (None, "u", "r" * 1500), (None, "u", "t" * 1300), (None, None, None)]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    found = {}
    for row in warc.archive(pages, frame=3000, bundle=6000).collect():
        reader = warc.Reader(bytes(row["data"]))
        for ident, *_ in reader.index():
            assert ident not in found
            found[ident] = warc.parse(reader.get(ident))
            assert found[ident][0]["WARC-Record-ID"] == f"<{ident}>"
    assert len(found) == len(odd)
    kept = Counter((f.get("X-Page"), f["WARC-Payload-Digest"]) for f, _ in found.values())
    assert kept == Counter((None if i is None else str(i), "sha1:" + hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in odd)
    for fields, payload in found.values():
        if fields["WARC-Type"] == "revisit":
            to, whole = found[fields["WARC-Refers-To"].strip("<>")]
            assert to["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"] and to["X-Page"] == fields["X-Refers-To-Page"] and payload == b""
            assert hashlib.sha1(whole).hexdigest() == fields["WARC-Payload-Digest"][5:]


def test_no_range_of_keys_is_crowded(spark):
    for weight in (1.0, 0.2, 0.05):
        keys = spark.range(200_000).select(mixing.order_key(F.col("id"), F.lit(weight)).alias("key"))
        bins = keys.groupBy(mixing._digit(0).alias("a"), mixing._digit(1).alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("a", "b").collect()
        assert max(r["n"] for r in bins) <= 200_000 // 1000 and all(x["hi"] <= y["lo"] for x, y in zip(bins, bins[1:], strict=False))


def test_mixing_by_a_column(spark):
    rows = spark.createDataFrame([(i, "w " * 20, "c" if i < 400 else f"b{i}", 1.0 if i % 2 else 0.1) for i in range(402)], "doc_id long, text string, source string, worth double")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(rows, weight=F.col("worth")).collect()}
    assert sum(got[i] for i in range(1, 400, 2)) > 1.5 * sum(got[i] for i in range(0, 400, 2))


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version, on odd rows with clashing names; and an empty table."""
    import corpus_pipeline

    from test_dedup import brute, shingles

    rng = np.random.default_rng(12)
    say = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 400, n))
    rows = [(None, None, None), (None, "no id", "a"), (1, "", "a"), (2, "short", None), (2, "short", None), (3, "x " * 4000, "b")]
    base = say(80)
    rows += [(10, base, "a"), (11, base + "  end", "b"), (12, base + "\tend", "b"), (13, base + " other", "a"), (13, base + " other", "a")]
    rows += [(100 + i, say(40) + (" vile" if i % 3 == 0 else ""), "abc"[i % 3] if i % 7 else None) for i in range(90)]
    folder = str(tmp_path / "data")
    spark.createDataFrame([(i, t, s, 1, "k", 2, 3) for i, t, s in rows], "doc_id long, text string, source string, size int, key string, _row int, label int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(0, 90)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages, made = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = made.columns, Counter(rows)
    for name, stage in list(stages.items())[:4]:
        made = materialize(stage(spark, made, folder), "stage")
        assert made.columns == columns
        got = Counter((r["doc_id"], r["text"], r["source"]) for r in made.collect())
        if name == "toxicity":
            want = Counter({r: n for r, n in now.items() if "vile" not in (r[1] or "")})
        elif name == "exact dedup":
            want = {}
            for r in sorted(now, key=lambda r: (r[0] is None, r[0] or 0)):
                want.setdefault(" ".join(re.split(r"[\x20\x09-\x0D]+", r[1] or "")), r)
            want = Counter(want.values())
        elif name == "n-gram Jaccard join":
            least = {(i, c) for i, _, c in brute([(r[0], r[1]) for r in now])}
            want = Counter(r for r in now if not shingles(r[1]) or (r[0], r[0]) in least)
        else:
            words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
            sizes, taken = Counter(), Counter()
            for r in now:
                sizes[r[2]] += words(r)
            for r, n in got.items():
                taken[r[2]] += words(r) * n
            goal = shared_out(dict(sizes))
            assert set(got) <= set(now) and all(abs(taken[s] - goal[s]) <= max(words(r) for r in now if r[2] == s) for s in goal)
            want = got
        assert got == want, name
        now = got
    packed = stages["best-fit packing"](spark, made, folder).collect()
    whole = Counter((r["doc_id"], r["ids_crc32"], r["piece"]) for r in packed)
    assert whole == Counter((r["doc_id"], r["ids_crc32"], r["piece"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert sum(r["piece"] == 0 for r in packed) == sum(now.values())
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_queries_have_their_columns(spark, data):
    from corpusloom.llm import queries

    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
    want = {
        "op1_warc_bundles": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op2_quality": ["doc_id", "held_out", "score", "predicted"],
        "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op8_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op9_near_duplicates": ["doc_id", "n_shingles", "component_id"], "op4_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, data).columns == columns
