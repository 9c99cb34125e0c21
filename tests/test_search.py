"""Lexical, dense and fused search; resolution and scores."""

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import embedders
from corpusloom.functions import windows as w
from corpusloom.operators import dense, fusion, lexical, resolve, score
from corpusloom.plans import build

DOCS = ["the cat sat on the mat", "the dog sat", "cat and dog and cat 1,000.5%", "", "the cat sat on the mat", None]
ASKED = ["cat mat cat", "dog", "nothing here", "", "1,000.5% the"]


def twin(docs, query, k1=1.2, b=0.75):
    token = re.compile(r"[a-z0-9]+(?:[.,][a-z0-9]+)*%?")
    lists = [token.findall((d or "").lower()) for d in docs]
    n, mean = len(lists), sum(map(len, lists)) / len(lists)
    df = Counter(t for x in lists for t in set(x))
    found = {}
    for row, x in enumerate(lists):
        tf = Counter(x)
        for t in dict.fromkeys(token.findall(query.lower())):
            if tf[t]:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                found[row] = found.get(row, 0.0) + idf * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(x) / mean))
    return sorted(found.items(), key=lambda p: (-p[1], p[0]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "row long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "qid long, text string")


def ranked(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["row"], r["score"]))
    return out


@pytest.mark.parametrize("restricted", [False, True])
def test_bm25_is_its_formula(docs, asked, restricted, tmp_path, spark):
    index = lexical.build_for(docs, asked) if restricted else lexical.build(docs)
    got = ranked(lexical.search(index, asked))
    for q, text in enumerate(ASKED):
        want = twin(DOCS, text)
        assert [r for r, _ in got.get(q, [])] == [r for r, _ in want]
        assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in want], rtol=1e-12)
    assert all(len(v) <= 1 for v in ranked(lexical.search(index, asked, 1)).values())
    if not restricted:
        index.save(str(tmp_path / "i"))
        again = ranked(lexical.search(lexical.Index.load(spark, str(tmp_path / "i")), asked))
        assert again == got


def test_empty_corpus(spark, asked):
    index = lexical.build(spark.createDataFrame([], "row long, text string"))
    assert index.stats.first()["avgdl"] == 0.0 and lexical.search(index, asked).count() == 0


def test_dense_is_the_inner_product(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8)).astype(np.float32)
    v[7] = v[3]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:5])], "qid long, embedding array<float>")
    monkeypatch.setattr(dense, "MOST_FLOATS", 16)  # two queries a turn
    got = ranked(dense.search(vectors, queries, 10))
    s = v[:5].astype(float) @ v.astype(float).T
    for q in range(5):
        assert [r for r, _ in got[q]] == sorted(range(50), key=lambda r: (-s[q, r], r))[:10]


def test_rrf_and_hybrid(spark, docs, asked):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "qid long, row long, rank int")
    b = spark.createDataFrame([(0, 3, 1), (0, 4, 2)], "qid long, row long, rank int")
    got = ranked(fusion.rrf([a, b]))[0]
    want = {1: 1 / 61, 2: 1 / 62, 3: 1 / 63 + 1 / 61, 4: 1 / 62}
    assert [r for r, _ in got] == [3, 1, 2, 4] and all(abs(s - want[r]) < 1e-15 for r, s in got)
    assert ranked(fusion.rrf([a, b], weights=[0.0, 1.0]))[0][0][0] == 3
    with pytest.raises(ValueError):
        fusion.rrf([a], weights=[1.0, 2.0])
    vectors = embedders.embed(docs, "hashing", {"dim": 16})
    embedded = embedders.embed(asked, "hashing", {"dim": 16})
    both = ranked(fusion.hybrid(lexical.build(docs), asked, vectors, embedded))
    full = fusion.rrf([dense.search(vectors, embedded), lexical.search(lexical.build(docs), asked)])
    assert both == ranked(full) and len(both[2]) == len(DOCS)


CHUNKS = [  # row, accession, document, section, text
    (0, "A1", "d1", "s1", "the  quick brown fox jumps"), (1, "A1", "d2", None, "the quick brown fox jumps"), (2, "A2", "d1", "s2", "a quick\nbrown fox"),
    (3, "A3", "d1", "s3", "quick brown fox quick brown fox"), (4, "A1", "d1", "s1", "quick brown fox again"), (5, "A1", "d1", "s1", "more quick brown fox"),
]
TRUTHS = [  # qid, ticker, accession, document, quote
    ("ok", "T", "A1", "d2", "quick  brown fox"), ("generic", "T", "A1", None, "quick brown fox"), ("any", "T", " any ", None, "brown fox"), ("none", "T", "A1", None, None),
    ("noacc", "T", "ZZ", None, "fox"), ("nodoc", "T", "A1", "d9", "fox"), ("absent", "T", "A2", None, "elephant"), ("split", "T", "A2", "d1", "fox runs"), ("case", "T", "A2", "ANY", "Quick"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(r, f"{a}:{d}:{r}", "T", a, d, "primary", s, "8-K", None, t) for r, a, d, s, t in CHUNKS]
    return resolve.normalised(spark.createDataFrame(rows, "row long, chunk_id string, ticker string, accession string, document string, doc_type string, section string, form string, filing_date string, text string")).cache()


@pytest.fixture(scope="module")
def truths(spark):
    return spark.createDataFrame([(q, 0, *x) for q, *x in TRUTHS], "qid string, member int, ticker string, accession string, document string, quote string")


def test_statuses(truths, chunks, monkeypatch):
    for most in (10_000, 0):  # broadcast needles, or inner words as keys
        monkeypatch.setattr(resolve, "MANY_NEEDLES", most)
        got = {r["qid"]: r for r in resolve.resolve(truths, chunks).collect()}
        assert {q: r["status"] for q, r in got.items()} == {"ok": "ok", "generic": "too_generic", "any": "dedup_measured", "none": "no_quote", "noacc": "accession_not_indexed", "nodoc": "document_not_indexed", "absent": "quote_absent", "split": "quote_absent", "case": "quote_absent"}
        assert got["ok"]["rows"] == [1] and got["ok"]["sections"] == ["None"] and got["ok"]["duplicate_text_count"] == 2
        assert got["any"]["match_count"] == 6 and got["any"]["distinct_accessions"] == 3 and got["any"]["distinct_texts"] == 5
        assert got["ok"]["corpus_accessions"] == 3 and got["generic"]["rows"] == [0, 1, 4, 5]


def test_verification_tells_split_from_absent(spark, truths, chunks):
    texts = spark.createDataFrame([("A2", "d1", "a quick brown fox runs on")], "accession string, document string, text string")
    t = truths.withColumn("key_status", F.when(F.col("qid") == "none", "NEEDS_QUOTE"))
    got = {r["qid"]: r["status"] for r in resolve.verify(t, chunks, texts).collect()}
    assert got["split"] == "split_across_chunks" and got["none"] == "awaiting_quote" and got["case"] == "quote_absent"
    assert got["absent"] == "document_unavailable"  # no document is named, and the only text is under a name
    bare = resolve.verify(t, chunks, texts.limit(0))
    assert {r["qid"]: r["status"] for r in bare.collect()}["split"] == "document_unavailable"
    assert sum(r["n"] for r in resolve.status_counts(bare).collect()) == len(TRUTHS)


def test_scores(spark, truths, chunks):
    hits = spark.createDataFrame(
        [("ok", 1, 0.9, 0), ("ok", 2, 0.8, 1), ("generic", 1, 0.7, 2), ("any", 1, 0.6, 3), ("neg", 1, 0.65, 5), ("none", 1, 0.1, 1)], "qid string, rank int, score double, row long"
    ).join(chunks.drop("norm", "duplicate_text_count"), "row")
    res = resolve.resolve(truths, chunks)
    one = {r["qid"]: r for r in score.single_fact(hits, res, (1, 5)).collect()}
    assert one["ok"]["rank"] == 2 and not one["ok"]["recall_at_1"] and one["ok"]["recall_at_5"] and not one["ok"]["citation_correct"]
    assert one["absent"]["rank"] is None and not one["absent"]["recall_at_5"] and one["absent"]["target_chunks"] == 0
    two = spark.createDataFrame([("ok", 0, "A1"), ("ok", 1, "A3")], "qid string, member int, accession string")
    cover = score.coverage(hits, two, True, (1, 5)).first()
    assert not cover["recall_at_5"] and cover["covered_at_5"] == 1 and cover["members_total"] == 2
    meaning = {r["qid"]: r["meaningful"] for r in score.target_recall(hits, res.filter("qid in ('ok', 'split')")).collect()}
    assert meaning == {"ok": False, "split": True}
    entries = spark.createDataFrame([("ok", "single_fact", "x", "q?"), ("neg", "negative_control", "x", "q?"), ("bad", "single_fact", "x", None), ("any", "dedup_diagnostic", "x", "q")], "qid string, type string, status string, question string")
    report = score.evaluate(entries, hits, res, (1, 5), section_tickers=["T"])
    assert report["rejected"].count() == 1
    head = report["headline"].first()
    assert head["median_separation"] == 0.25 and head["distributions_overlap"] is False
    assert report["by_type"].first()["recall_at_5"] == 1.0
    section = report["section_accuracy"].first()
    assert section["n"] == 1 and section["correct"] == 0  # the hit's label is s1, the target has none
    assert report["dedup"].first()["distinct_texts"] == 1


def test_build_resume_and_search(spark, tmp_path):
    html = "<html><body><p>Item 1 {}</p><p>{}</p></body></html>"
    raw = spark.createDataFrame(
        [("1", "T", f"A{i}", "8-K", "2024-01-01", None, "primary", "d.htm", None, html.format("fox " * 60, f"word{i} tail. " * 60)) for i in range(3)],
        "cik string, ticker string, accession string, form string, filing_date string, period_of_report string, doc_type string, document string, exhibit_label string, html string",
    )
    path, how = str(tmp_path / "ix"), w.CharWindows(200, 40)
    anchors = {"_default": [{"label": "item_{0}", "pattern": r"item\s*(\d)"}]}
    rows = build.build(raw, path, how, anchors, least=50)
    n = rows.count()
    assert n > 6 and sorted(r["row"] for r in rows.select("row").collect()) == list(range(n))
    for r in rows.join(build.documents(raw).select("accession", F.col("text").alias("t")), "accession").collect():
        assert r["t"][r["char_span"]["start"] : r["char_span"]["end"]].strip() == r["text"]
    again = build.build(raw, path, how, anchors, least=50)
    assert again.count() == n  # nothing is embedded twice
    with pytest.raises(ValueError, match="was built with"):
        build.embed_index(rows, path, "hashing", {"dim": 8})
    asked = spark.createDataFrame([(0, rows.filter("accession = 'A2'").orderBy(F.desc("row")).first()["text"])], "qid long, text string")
    found = build.Retriever(spark, path)
    for kind in ("lexical", "dense", "hybrid"):
        top = found.search(asked, 3, kind).orderBy("rank").first()
        assert top["accession"] == "A2" and top["rank"] == 1
    with pytest.raises(ValueError):
        build.Retriever(spark, path, "hashing", {"dim": 8})


def test_registry():
    with pytest.raises(ValueError):
        embedders.register("hashing")(object)
    with pytest.raises(KeyError):
        embedders.get("absent")
    model = embedders.get("hashing", dim=8)
    assert isinstance(model, embedders.Embedder) and np.allclose(np.linalg.norm(model.embed_documents(["a b", "", "c"]), axis=1), 1)
    assert [len(x) for x in embedders.batches(["a"] * 5, 2)] == [2, 2, 1]
    assert [len(x) for x in embedders.batches(["a" * 30] * 3 + ["b" * 300], 9, 25)] == [2, 1, 1]


def test_dense_blocks_are_bounded_and_equal_vectors_tie(spark, monkeypatch):
    """A task never scores all queries with a whole batch, and copies of a vector have the same score wherever they lie."""
    rng = np.random.default_rng(2)
    v = np.tile(rng.normal(size=(37, 13)).astype(np.float32), (5, 1))
    rows, asked = [(i, x.tolist()) for i, x in enumerate(v)], [(i, x.tolist()) for i, x in enumerate(v[:70])]
    vectors = spark.createDataFrame(rows, "row long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(asked, "qid long, embedding array<float>")
    for name, value in (("HELD_FLOATS", 13 * 40), ("BLOCK", 8), ("MANY_QUERIES", 50)):
        monkeypatch.setattr(dense, name, value)
    block = dense.InnerProduct.block

    def bounded(ids, asked, rows, held):
        if len(asked) > 8:
            raise ValueError("too many queries at a time")
        return block(ids, asked, rows, held)

    monkeypatch.setattr(dense.InnerProduct, "block", staticmethod(bounded))
    got = ranked(dense.search(vectors, queries, 7))
    for q in range(70):
        s = [reduce(lambda t, p: t + float(p[0]) * float(p[1]), zip(v[q], x, strict=True), 0.0) for x in v]  # sum() compensates
        assert got[q] == [(r, s[r]) for r in sorted(range(len(v)), key=lambda r: (-s[r], r))[:7]]
    assert dense.search(vectors, queries.limit(0), 7).count() == 0 and dense.search(vectors.limit(0), queries, 7).count() == 0
    with pytest.raises(ValueError):
        dense.search(vectors, spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "qid long, embedding array<float>"), 7)


@pytest.mark.parametrize("n, top", [(400, 3), (400, 20), (15, 20)])
def test_fused_scores_equal_full_rankings(spark, monkeypatch, n, top):
    rng = np.random.default_rng(n + top)
    v = rng.normal(size=(n, 4)).astype(np.float32)
    v[n // 2 :] = v[: n - n // 2]  # ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, embedding array<float>").repartition(3)
    queries = vectors.filter("row % 5 = 0").withColumnRenamed("row", "qid")
    monkeypatch.setattr(dense, "HELD_FLOATS", 4 * 60)
    first = dense.search(vectors, queries)
    second = lexical.ranking(first.select("qid", "row", (-F.abs(F.col("qid") - F.col("row"))).alias("score")))
    want = ranked(fusion.rrf([first, second]).filter(F.col("rank") <= top))
    made = fusion.rrf_of_scores(vectors, queries, [dense.InnerProduct, fusion.NearestId], top, 60 if n < 100 else 5)
    if n < 100:
        assert ranked(made) == want
    else:
        assert ranked(made) == ranked(fusion.rrf([first, second], 5).filter(F.col("rank") <= top))


def test_bm25_by_scanning_equals_the_index_without_shuffled_postings(spark, docs, asked, monkeypatch):
    want = ranked(lexical.search(lexical.build(docs), asked))
    made = lexical.best(docs.repartition(3), asked)
    assert {q: [r for r, _ in x] for q, x in ranked(made).items()} == {q: [r for r, _ in x] for q, x in want.items()}
    for q, x in ranked(made).items():
        assert np.allclose([s for _, s in x], [s for _, s in want[q]], rtol=1e-12)
    top = lexical.best(docs.repartition(3), asked, 2)
    assert {q: [r for r, _ in x] for q, x in ranked(top).items()} == {q: [r for r, _ in x[:2]] for q, x in want.items()}
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # no postings
    assert lexical.scan(docs.coalesce(1), asked, 1).count() == len(want)  # a task passes on its best only
    assert lexical.best(docs.limit(0), asked, 2).count() == 0 and lexical.best(docs, asked.limit(0), 2).count() == 0
    monkeypatch.setattr(lexical, "MANY_TERMS", 1)
    assert {q: [r for r, _ in x] for q, x in ranked(lexical.best(docs, asked, 2)).items()} == {q: [r for r, _ in x[:2]] for q, x in want.items()}


def test_hybrid_by_scans_makes_whole_rankings_for_shared_questions_only(spark, docs, asked, monkeypatch):
    vectors = embedders.embed(docs, "hashing", {"dim": 16}).select("row", "embedding")
    embedded = embedders.embed(asked.filter("qid in (0, 2)").unionByName(spark.createDataFrame([(9, "dog mat")], "qid long, text string")), "hashing", {"dim": 16})
    deep, search = [], dense.search
    monkeypatch.setattr(dense, "search", lambda v, q, top=None: (deep.extend(r["qid"] for r in q.collect()) if top is None else None, search(v, q, top))[1])
    got = ranked(fusion.hybrid_by_scans(docs, asked, vectors, embedded, 3))
    assert sorted(deep) == [0, 2]
    want = ranked(fusion.rrf([search(vectors, embedded), lexical.search(lexical.build(docs), asked)]).filter("rank <= 3"))
    assert got == want and 9 in got and 1 in got


def test_resolution_reads_the_texts_once(spark, tmp_path):
    rows = [(r, f"c{r}", "T", a, d, s, t) for r, a, d, s, t in CHUNKS]
    spark.createDataFrame(rows, "row long, chunk_id string, ticker string, accession string, document string, section string, text string").write.parquet(str(tmp_path / "c"))
    chunks = resolve.normalised(spark.read.parquet(str(tmp_path / "c")))
    quotes = [("a", 0, "T", "ANY", None, "quick brown fox jumps"), ("b", 0, "T", "A3", None, "fox quick brown"), ("c", 0, "T", "ANY", None, "none of these")]
    truths = spark.createDataFrame(quotes, "qid string, member int, ticker string, accession string, document string, quote string")
    made = resolve.resolve(truths, chunks)
    leaves = made._jdf.queryExecution().sparkPlan().collectLeaves()  # with the columns that are read
    assert sum("text#" in leaves.apply(i).output().toString() for i in range(leaves.size())) == 1
    got = {r["qid"]: r for r in made.collect()}
    assert got["a"]["rows"] == [0, 1] and got["a"]["duplicate_text_count"] == 2 and got["a"]["distinct_texts"] == 1 and got["a"]["corpus_accessions"] == 1
    assert got["b"]["rows"] == [3] and got["b"]["status"] == "ok" and got["b"]["corpus_chunks"] == 1 and got["c"]["status"] == "quote_absent"


def test_scores_read_hits_and_resolutions_once(spark, tmp_path):
    spark.createDataFrame([("a", 1, 0, "c0", "A1", "d1"), ("a", 2, 1, "c1", "A2", None), ("b", 1, 2, "c2", "A3", "d")], "qid string, rank int, row long, chunk_id string, accession string, document string").write.parquet(str(tmp_path / "h"))
    goals = [("a", 0, "A2", None, ["c1", "c9"]), ("a", 1, "A1", "d1", ["c9"]), ("b", 0, "A9", "d", ["c7"]), ("n", 0, "A1", None, ["c0"])]
    spark.createDataFrame(goals, "qid string, member int, accession string, document string, chunk_ids array<string>").write.parquet(str(tmp_path / "r"))
    hits, res = (spark.read.parquet(str(tmp_path / n)) for n in "hr")
    one, far, near = score.single_fact(hits, res, (1, 5)), score.coverage(hits, res, False, (1, 5)), score.coverage(hits, res, True, (1, 5))
    for made in (one, far, near):
        assert made._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    got = {r["qid"]: r for r in one.collect()}
    assert got["a"]["rank"] == 2 and got["a"]["target_chunks"] == 2 and got["a"]["citation_correct"] and not got["a"]["recall_at_1"]
    assert got["b"]["rank"] is None and not got["b"]["citation_correct"] and got["n"]["rank"] is None and got["n"]["target_chunks"] == 1
    assert {r["qid"]: (r["covered_at_5"], r["members_total"], r["recall_at_5"]) for r in far.collect()} == {"a": (1, 2, False), "b": (0, 1, False), "n": (0, 1, False)}
    assert {r["qid"]: (r["covered_at_5"], r["members_total"], r["recall_at_5"]) for r in near.collect()} == {"a": (2, 2, True), "b": (0, 1, False), "n": (0, 1, False)}
