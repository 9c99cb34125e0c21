"""Quality and toxicity: held-out accuracy, and the models against their definitions."""

import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import quality, toxicity
from corpusloom.llm.labels import consumed

def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 4)))
    at, value = np.array([3, 10, 500, 8200]), rng.normal(size=4)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * value[i] * value[j] for i, j in itertools.combinations(range(4), 2))
    assert abs(m.margin(at, value) - (0.3 + m.linear[at] @ value + pairs)) < 1e-9


@given(st.integers(1, 5), st.data())
@settings(max_examples=40, deadline=None)
def test_marginals_are_those_of_all_taggings(n, data):
    odds = np.exp(np.array(data.draw(st.lists(st.floats(-3, 3), min_size=n, max_size=n))))[:, None]
    moves = np.exp(np.array(data.draw(st.lists(st.floats(-2, 2), min_size=4, max_size=4)))).reshape(2, 2)
    total, on, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        weight = np.prod([odds[t, 0] if y else 1 for t, y in enumerate(tags)]) * np.prod([moves[a, b] for a, b in zip(tags, tags[1:], strict=False)])
        total += weight
        on += weight * np.array(tags)
        for a, b in zip(tags, tags[1:], strict=False):
            pairs[a, b] += weight
    assert np.allclose(toxicity.marginals(odds, moves)[:, 0], on / total)
    if n > 1:
        assert np.allclose(toxicity.pair_marginals(odds, moves), pairs / total)
    padded = np.concatenate([odds, np.full((3, 1), 1e-13)])
    both = np.concatenate([padded, np.concatenate([odds, odds[:1], odds[:1], odds[:1]])], axis=1)
    assert np.allclose(toxicity.marginals_padded(both, np.array([n, n + 3]), moves)[:n, 0], on / total)


def test_long_texts_are_tagged_exactly():
    """Chains side by side, chains alone and the plain recursion agree, for a fitted model too."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(300)])
    label = np.array([float(i % 3 == 0) for i in range(240)])
    texts = [" ".join([*words[rng.integers(0, 300, 50)], *(["vile", "w7"] if y else [])]) for y in label]
    made = toxicity.fit(texts, label)
    for model in (made, toxicity.Chain(rng.normal(-2, 2, toxicity.TOKENS * toxicity.SHAPES), np.array([[0.0, -1.0], [-1.0, 2.0]]))):
        long_ = [rng.integers(0, toxicity.TOKENS * toxicity.SHAPES, n) for n in (50_000, 0, 3, *[200_000] * 2, *[70] * 20)]
        for x, p in zip(long_, model.tag(long_), strict=True):
            whole = toxicity.marginals(np.exp(np.clip(model.emission[x], -30, 30))[:, None], np.exp(model.moves))[:, 0] if len(x) else np.zeros(0)
            assert len(p) == len(x) and np.allclose(p, whole, rtol=1e-9, atol=1e-15)


def test_clean_texts_speak_against_tags():
    """A type that is tagged in toxic texts but stands in clean ones as well is believed less."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(50)])
    label = np.array([float(i % 4 == 0) for i in range(800)])
    held = np.where(label == 1, True, rng.random(800) < 0.2)
    texts = [" ".join([*words[rng.integers(0, 50, 30)], *(["vile"] if h else [])]) for h in held]
    clear = [" ".join([*words[rng.integers(0, 50, 30)], *(["vile"] if y else [])]) for y in label]
    at = toxicity.Places()["vile"]
    assert toxicity.fit(texts, label).emission[at] < toxicity.fit(clear, label).emission[at]


def metrics(rows, truth):
    held = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    s, y, p = (np.array(x, float) for x in zip(*held, strict=True))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    return auc, (p == y).mean()


@pytest.mark.parametrize("op,label,folder,modulus,held,auc,accuracy", [(quality.quality, "quality", "sf0.01", 5, 0, 0.95, 0.93), (toxicity.toxicity, "toxic", "sf0.1", 4, 2, 0.92, 0.95)])
def test_held_out_accuracy(spark, op, label, folder, modulus, held, auc, accuracy):
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = op(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in rows)
    got = metrics(rows, {r["doc_id"]: r[label] for r in labels.collect()})
    assert got[0] >= auc and got[1] >= accuracy


@pytest.mark.parametrize("op,label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_odd_rows(spark, op, label):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "word " * 30_000), (5, "😀 é \0")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, predicted string")
    some = spark.createDataFrame([(9, 1, 0), (None, 0, 1), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0)):
        got = op(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert {r["score"] for r in got if r["doc_id"] == 3}.__len__() == 1
        assert next(r for r in got if r["doc_id"] is None)["held_out"]
    assert op(docs.limit(0), some).count() == 0


def test_offending_spans(spark):
    words = "calm tree river stone light road".split()
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(240):
        text = [words[k] for k in rng.integers(0, 6, 60)]
        if bad := i % 3 == 0:
            for k in rng.integers(0, 60, 4):
                text[k] = "Vile!"
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), carry=True).collect()
    for r in got:
        assert r["predicted"] == (r["doc_id"] % 3 == 0) and r["_row"]["doc_id"] == r["doc_id"]
        assert {r["_row"]["text"][s["start"] : s["end"]] for s in r["spans"]} == ({"Vile!"} if r["predicted"] else set())


def test_a_common_opening_makes_no_copies():
    words = "calm tree river stone light road".split()
    rng = np.random.default_rng(6)
    opening, label = " ".join(f"licence{i}" for i in range(20)), np.array([float(i % 4 == 0) for i in range(200)])
    texts = [" ".join([opening, *(words[k] for k in rng.integers(0, 6, 60)), "vile" if y else "mild"]) for y in label]
    model = toxicity.fit(texts, label)
    assert model.tagged == 1
    scores = [model.score(p) for p in model.tag([np.array([toxicity.Places()[w] for w in t.split()]) for t in texts])]
    assert [s >= 0.3 for s in scores] == [bool(y) for y in label]
    copied = [texts[0]] * 50 + texts  # its other words stay innocent
    assert toxicity.fit(copied, np.concatenate([np.ones(50), label])).tagged == 1


def test_pairs_of_padded_chains_stop_at_their_ends():
    rng = np.random.default_rng(8)
    odds, moves, ends = np.exp(rng.normal(size=(7, 4))), np.exp(rng.normal(size=(2, 2))), np.array([1, 3, 6, 7])
    alone = sum(np.array(toxicity.pair_marginals(odds[:n, k : k + 1], moves)) for k, n in enumerate(ends) if n > 1)
    assert np.allclose(toxicity.pair_marginals(odds, moves, ends), alone)


@pytest.mark.parametrize("size,place", [(12, None), (60, 55)])  # short texts; hits at the end of long ones
def test_short_texts_and_ends_train(size, place):
    words = "calm tree river stone light road".split()
    rng = np.random.default_rng(9)
    label, texts = np.array([float(i % 3 == 0) for i in range(480)]), []
    for y in label:
        text = [words[k] for k in rng.integers(0, 6, size)]
        if y:
            text[rng.integers(0, size) if place is None else place] = "vile"
        texts.append(" ".join(text))
    model = toxicity.fit(texts, label)
    marginal = model.tag([np.array([toxicity.Places()[w] for w in t.split()]) for t in texts])
    assert [model.score(p) >= 0.3 for p in marginal] == [bool(y) for y in label]
    assert all((p >= 0.5).tolist() == [w == "vile" for w in t.split()] for t, p in zip(texts, marginal, strict=True))


def peak(run):
    """Bytes that Python and numpy hold at most while ``run`` runs, beyond those held before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_scoring_holds_little_beside_the_texts():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k:04d}" for k in rng.integers(0, 3000, 400)) + (" vile" * 3 if i % 4 == 0 else "") for i in range(800)]
    size, label = sum(map(len, texts)), np.arange(800) % 4 == 0
    model = toxicity.fit(texts, label.astype(float), rounds=1)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(800)), "text": texts, "_row": pa.nulls(800, pa.int32())})
    assert peak(lambda: list(toxicity.scorer(model)(iter([batch])))) < 12 * size


def test_scoring_holds_no_more_for_a_larger_batch():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k:04d}" for k in rng.integers(0, 3000, 400)) for _ in range(8000)]
    model = toxicity.Chain(rng.normal(-6, 1, toxicity.TOKENS * toxicity.SHAPES), weights=np.ones(3))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8000)), "text": texts, "_row": pa.nulls(8000, pa.int32())})
    assert peak(lambda: [out.num_rows for out in toxicity.scorer(model)(iter([batch]))]) < 40_000_000


def test_blocks_of_any_size_tag_alike(monkeypatch):
    rng = np.random.default_rng(11)
    model = toxicity.Chain(rng.normal(-2, 2, toxicity.TOKENS * toxicity.SHAPES), np.array([[0.0, -1.0], [-1.0, 2.0]]))
    documents = [rng.integers(0, toxicity.TOKENS * toxicity.SHAPES, n) for n in rng.integers(0, 300, 200)]
    want = model.tag(documents)
    for cells in (1, 5000, 1 << 22):
        monkeypatch.setattr(toxicity, "CELLS", cells)
        assert all(np.array_equal(p, q) for p, q in zip(model.tag(documents), want, strict=True))


def test_the_toxicity_stage_scores_small_batches(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    made = toxicity.scorer

    def strict(*of):
        inner = made(*of)

        def score(batches):
            def seen():
                for b in batches:
                    if b.nbytes > 5_000_000:
                        raise ValueError(f"a batch of {b.nbytes} bytes")
                    yield b

            return inner(seen())

        return score

    monkeypatch.setattr(toxicity, "scorer", strict)
    docs = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "concat(id, ' ', repeat('calm ', 400), if(id % 3 = 0, 'vile', '')) as text")
    spark.range(0, 300).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert left.columns == ["doc_id", "text"] and {r.doc_id for r in left.select("doc_id").collect()} == {i for i in range(6000) if i % 3}


def test_consumed_texts_are_let_go():
    held = ["a", "b"]
    assert next(texts := consumed(held)) == "a" and held == ["", "b"] and list(texts) == ["b"]


def test_text_is_found_in_its_row(spark):
    rows = [(i, None, "a vile word" if i % 3 else "a fine word", "x") for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, score string, Text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(1, 40)], "doc_id long, toxic int")
    plain = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    carried = toxicity.toxicity(docs, labels, carry=True).collect()
    assert {r.doc_id: r.score for r in carried} == plain and {tuple(r._row) for r in carried} == set(rows)
