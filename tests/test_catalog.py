"""Readers, writers, discovery, ledgers, audit, configuration and ingestion."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import config as cf
from corpusloom import schemas as s
from corpusloom.operators import audit, discover, ledgers
from corpusloom.sources import http, sinks, tables
from corpusloom.streaming import ingest


def manifest(spark, *rows):
    return spark.createDataFrame(list(rows), s.MANIFEST)


ROWS = [
    ("0000000001", "B", "0000000001-24-000001", "8-K", "2024-01-02", None, "primary", None, "a.htm", "u"),
    ("0000000001", "B", "0000000001-24-000001", "8-K", "2024-01-02", None, "exhibit", "EX-99.1", "x.htm", "u,1"),
    ("0000000001", "A", "0000000001-24-000002", "8-K", "2024-03-02", "2024-02-01", "primary", None, "b.htm", 'u"q'),
    ("0000000001", "B", "0000000001-24-000003", "10-Q", "2024-05-02", None, "primary", None, None, None),
]


def test_manifest_round_trip_is_byte_identical(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    sinks.manifest(manifest(spark, *ROWS), str(a))
    sinks.manifest(manifest(spark, *ROWS[::-1]).repartition(3), str(b))
    assert a.read_bytes() == b.read_bytes() and b"\r" not in a.read_bytes()
    back = tables.manifest(spark, str(a)).collect()
    assert [tuple(r) for r in back] == [ROWS[2], ROWS[3], ROWS[0], ROWS[1]]
    a.write_text("cik,ticker\n1,2\n")
    with pytest.raises(ValueError, match="has the columns"):
        tables.manifest(spark, str(a))


def test_legacy_tables(spark, tmp_path):
    old = tmp_path / "m.csv"
    old.write_text(",".join(s.LEGACY_MANIFEST.fieldNames()) + "\n0000000001,B,A1,8-K,2024-01-02,,https://x/y/a.htm\n")
    with pytest.raises(ValueError, match="before exhibits"):
        tables.manifest(spark, str(old))
    new = tables.manifest(spark, str(old), allow_legacy=True)
    assert new.first()["document"] == "a.htm" and new.first()["doc_type"] == "primary"
    led = tmp_path / "l.csv"
    led.write_text(",".join(s.LEGACY_FETCHED.fieldNames()) + "\nA1,p.html,error,0,,,t1\nA1,p.html,ok,5,text/html,s,t2\n")
    rows = tables.fetch_ledger(spark, str(led), new).collect()
    assert len(rows) == 1 and rows[0]["status"] == "ok" and rows[0]["document"] == "a.htm"
    assert tables.any_ledger(spark, str(led)).count() == 2
    with pytest.raises(ValueError):
        tables.fetch_ledger(spark, str(led))


def test_universe(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("ticker,cik,company_name\n zzyx ,418207,Zyxo\n")
    assert tuple(tables.universe(spark, str(p)).first()) == ("ZZYX", "0000418207", "Zyxo")
    p.write_text("ticker,cik,company_name\n")
    with pytest.raises(ValueError):
        tables.universe(spark, str(p))
    known = tables.company_tickers(spark, '{"0": {"cik_str": 1, "ticker": "a", "title": "A Inc"}, "1": {"cik_str": 2, "ticker": "b", "title": "B"}, "2": {"cik_str": 3, "ticker": "B", "title": "B2"}}')
    want = lambda t: spark.createDataFrame([(t,)], "ticker string")
    assert tuple(discover.match_universe(want("A"), known).first()) == ("A", "0000000001", "A Inc")
    for bad, n in (("B", 2), ("Z", 0)):
        with pytest.raises(Exception, match=f"{bad} matches {n}"):
            discover.match_universe(want(bad), known).collect()
    with pytest.raises(Exception, match="without cik"):
        tables.company_tickers(spark, '{"0": {"title": "x"}}').collect()


def test_chunk_scan(spark, tmp_path):
    rec = lambda f, i: json.dumps({"chunk_id": f"{f}{i}", "accession": f, "chunk_ordinal": i, "text": "t", "n_tokens": 1, "char_span": [i, i + 1], "cik": "1", "form": "8-K"})
    (tmp_path / "b.jsonl").write_text(rec("b", 0) + "\n")
    (tmp_path / "a.jsonl").write_text(rec("a", 0) + "\n\n" + rec("a", 1) + "\n" + rec("a", 2))
    rows = tables.chunks(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r["row"], r["chunk_id"]) for r in rows] == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "b0")]
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="c.jsonl"):
        tables.chunks(spark, str(tmp_path)).collect()


def test_questions_and_key(spark, tmp_path):
    p = tmp_path / "q.txt"
    p.write_text("# note\n\n first? \nsecond\n")
    assert [r["text"] for r in tables.questions(spark, str(p)).orderBy("qid").collect()] == ["first?", "second"]
    entries, truths = tables.answer_key(spark, [{"id": 1, "type": "negative_control", "ground_truth": None}, {"id": "b", "ground_truth": {"accession": "A", "quote": "q"}}, {"id": "c", "ground_truth": [{"quote": "x"}, "junk", {"quote": "y"}]}])
    assert entries.count() == 3 and sorted((r["qid"], r["member"], r["quote"]) for r in truths.collect()) == [("b", 0, "q"), ("c", 0, "x"), ("c", 1, "y")]
    from corpusloom.operators.resolve import unwritten

    assert [tuple(r) for r in unwritten(entries, truths).collect()] == [("1", "negative_control")]
    with pytest.raises(ValueError):
        tables.answer_key(spark, {"a": 1})


BLOCK = {"filings": {"recent": {"accessionNumber": ["000000000124000001", "000000000124000002", "000000000124000003", "000000000124000001", "x"], "filingDate": ["2024-01-02", "2023-01-01", "", "2024-01-03"], "reportDate": ["", "", "", ""], "form": ["8-K", "8-K", "8-K", "8-K", "8-K"], "primaryDocument": ["a.htm", "b.htm", "c.htm", "z.htm"]}, "files": []}}
HEADERS = "<PRE>&lt;DOCUMENT&gt;\n&lt;TYPE&gt;8-K\n&lt;FILENAME&gt;a.htm\n&lt;DOCUMENT&gt;\n&lt;TYPE&gt;EX-99.1\n&lt;SEQUENCE&gt;2\n&lt;FILENAME&gt;ex991.htm\n&lt;DOCUMENT&gt;\n&lt;TYPE&gt;EX-99.2\n&lt;DESCRIPTION&gt;no file\n&lt;/SEC-HEADER&gt;"


def test_discovery(spark):
    payload = spark.createDataFrame([("0000000001", "B", json.dumps(BLOCK))], "cik string, ticker string, json string")
    filings = discover.unpivot(tables.submissions(spark, payload), tables.SUBMISSION)
    assert filings.count() == 4  # the shortest column
    rows, problems = discover.manifest_rows(filings, "https://x", ["8-K"], "2024-01-01", "2024-12-31")
    (row,) = rows.collect()
    assert row["accession"] == "0000000001-24-000001" and row["document"] == "a.htm" and row["period_of_report"] is None and row["doc_url"].endswith("/1/000000000124000001/a.htm")
    assert {r["problem"] for r in problems.collect()} == {"no filingDate", "no reportDate"}
    heads = tables.index_headers(spark.createDataFrame([("0000000001-24-000001", HEADERS)], "accession string, payload string"))
    assert [(r["type"], r["filename"], r["sequence"]) for r in heads.orderBy("nth").collect()] == [("8-K", "a.htm", None), ("EX-99.1", "ex991.htm", "2"), ("EX-99.2", None, None)]
    named, bare = discover.exhibit_rows(rows, heads, "https://x", ["EX-99"])
    assert [(r["document"], r["exhibit_label"], r["doc_type"]) for r in named.collect()] == [("ex991.htm", "EX-99.1", "exhibit")] and bare.count() == 1
    seen = discover.counters(rows, heads)
    assert seen["types_seen"].count() == 3 and seen["by_ticker"].first()["n"] == 1
    shards = spark.createDataFrame([("2020-01-01", "2020-12-31"), ("2023-06-01", "2024-02-01"), ("bad", "2020-01-01"), (None, None)], "a string, b string")
    assert [r[0] for r in shards.select(discover.shard_overlaps(F.col("a"), F.col("b"), "2024-01-01", "2024-12-31")).collect()] == [False, True, True, True]


def test_ledgers(spark):
    led = spark.createDataFrame([("A", "d", "p", "ok", "3", 1), ("A", "d", "p", "error", "3", 2), ("B", None, "q", "ok", "4", 1), ("C", "", "r", "ok", "9", 1)], "accession string, document string, path string, status string, bytes string, seq int")
    want = spark.createDataFrame([("A", "d"), ("B", None), ("C", None), ("D", "z")], "accession string, document string")
    files = spark.createDataFrame([("p", 3), ("q", 4), ("r", 8)], "path string, length long")
    assert sorted(r["accession"] for r in ledgers.to_fetch(want, led, files).collect()) == ["A", "C", "D"]
    assert {r["accession"]: r["status"] for r in ledgers.latest(led).collect()} == {"A": "error", "B": "ok", "C": "ok"}
    assert ledgers.keep_first(led, ("accession",)).filter("accession = 'A'").first()["status"] == "ok"
    assert ledgers.duplicates(led, ("accession",)).first()["extra"] == 1
    ok, rest = ledgers.split_available(want, led.withColumn("sha256", F.lit("s")))
    assert sorted(r["accession"] for r in ok.collect()) == ["B", "C"] and rest.count() == 2
    parsed = spark.createDataFrame([("A", "d", "s1", "f", "o1", 1), ("B", "", "s2", "f", "gone", 1)], "accession string, document string, doc_sha256 string, config_fingerprint string, path string, seq int")
    docs = spark.createDataFrame([("A", "d", "s1"), ("B", None, "s2"), ("E", "e", "s3")], "accession string, document string, doc_sha256 string")
    outs = spark.createDataFrame([("o1",)], "path string")
    assert sorted(r["accession"] for r in ledgers.to_parse(docs, parsed, "f", outs).collect()) == ["B", "E"]
    assert ledgers.to_parse(docs, parsed, "other", outs).count() == 3


def test_audit(spark):
    m = manifest(spark, *ROWS)
    led = spark.createDataFrame([(ROWS[0][2], "", "p0", "ok", "10"), (ROWS[1][2], "x.htm", "p1", "ok", "5"), (ROWS[2][2], "b.htm", "p2", "ok", "7"), (ROWS[3][2], "none", "p3", "ok", "1")], "accession string, document string, path string, status string, bytes string")
    texts = spark.createDataFrame([("p0", "cover Item 2.02 words Exhibit 99 and exhibit 10.1 SIGNATURE x signature"), ("p1", "press"), ("p2", "nothing")], "path string, text string")
    docs, missing = audit.audit(m, led, texts, r"item\s*(\d\.\d\d)", r"signatures?", r"exhibit\s+(\d+(?:\.\d+)?)")
    got = {r["file"]: r for r in docs.collect()}
    assert missing.count() == 1 and got["p0"]["items"] == ["2.02"] and got["p0"]["exhibits_referenced"] == ["10.1", "99"] and got["p0"]["exhibits_unresolved"] == ["10.1"]
    assert got["p0"]["item_chars"] == len("Item 2.02 words Exhibit 99 and exhibit 10.1 SIGNATURE x") and got["p2"]["item_chars"] == 0
    forms = {r["grp"]: r for r in audit.by_form(docs, 10, 10).collect()}
    assert forms["8-K/primary"]["count"] == 2 and forms["8-K/primary"]["item_anchor_matched"] == 1 and forms["8-K/primary"]["under_short_text"] == 1
    assert audit.funnel(docs).first()["with_unresolved"] == 1 and audit.by_ticker(docs).count() == 2
    assert audit.sample(docs, 1, 3).count() == 2
    census = audit.duplicate_census(spark.createDataFrame([("x", "T", "8-K", "primary")] * 3 + [("y", "T", "8-K", "primary")], "text string, ticker string, form string, doc_type string"))
    assert tuple(census["totals"].first()) == (4, 2, 3, 2) and census["by_form"].first()["n"] == 3 and census["largest"].count() == 1


def test_http_client():
    now, slept = [0.0], []

    def sleep(x):
        slept.append(x)
        now[0] += x

    limiter = http.Limiter(2, clock=lambda: now[0], sleep=sleep)
    answers = [(429, {"Retry-After": "7"}, b""), (503, {}, b""), (200, {}, b"ok")]
    client = http.Client("me", tries=3, opener=lambda *a: answers.pop(0), limiter=limiter)
    assert client.get("u") == "ok" and max(slept) >= 7 and client.requests == 3
    with pytest.raises(OSError, match="404"):
        http.Client("me", opener=lambda *a: (404, {}, b""), limiter=limiter).get("u")
    with pytest.raises(ValueError):
        http.Limiter(0)


def test_ledgers_are_read_as_they_were_written(spark, tmp_path):
    entry = lambda a, d, status, at: (a, d, "primary", "p", status, "1", "text/html", "s", at)
    path = str(tmp_path / "ledger")
    for rows in ([entry("1", "a", "failed", "t0"), entry("2", "b", "ok", "t0")], [entry("1", "a", "ok", "t1"), entry("1", None, "ok", "t1")]):
        sinks.append(spark.createDataFrame(rows, s.FETCHED), path)
    got = lambda: sorted((r["accession"], r["document"] or "", r["status"]) for r in tables.appended(spark, path).collect())
    want = [("1", "", "ok"), ("1", "a", "ok"), ("2", "b", "ok")]
    assert got() == want and tables.appended(spark, path).columns == s.FETCHED.fieldNames()
    spark.catalog.clearCache()
    sinks.rewrite(tables.appended(spark, path), path)
    assert got() == want and spark.read.parquet(path).count() == 3


def test_rows_of_a_null_group_are_numbered(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("g", 5), ("a", 7)], "f string, n int")
    assert sorted((r["row"], r["f"], r["n"]) for r in tables.numbered(rows, "f", "n").collect()) == [(0, None, 1), (1, None, 2), (2, "a", 7), (3, "g", 5)]


def test_override_words():
    assert [cf.scalar(x) for x in ("yes", " On ", "no", "off", "~", " padded ", "-4", "0.5", '{"a": [1]}', "[oops", "NaN", "2024-01-05")] == [True, True, False, False, None, "padded", -4, 0.5, {"a": [1]}, "[oops", "NaN", "2024-01-05"]


def test_config_and_log(tmp_path, monkeypatch):
    c = cf.Config({"a": {"b": 1}})
    c.set("a.c.d", cf.scalar("[1, 2]"))
    assert c.get("a.c.d") == [1, 2] and c.get("x.y", None) is None and cf.scalar("null") is None and cf.scalar("1e3") == 1000.0 and cf.scalar("True") is True and cf.scalar("text") == "text"
    with pytest.raises(KeyError):
        c.get("a.z")
    with pytest.raises(ValueError):
        c.set("a.b.c", 1)
    monkeypatch.setenv("SOME_KEY", "v")
    c.set("key", "SOME_KEY")
    assert c.secret("key") == "v"
    side = {"embedder": {"m": 1}, "dim": 8, "metric": "ip", "count": 5}
    assert cf.check_binding(cf.index_fingerprint(side), side)
    with pytest.raises(ValueError):
        cf.check_binding(cf.index_fingerprint(side), side | {"count": 6})
    log = tmp_path / "log.jsonl"
    with pytest.raises(RuntimeError), cf.RunLog(str(log)) as run, run.stage("one") as stage:
        stage.count(items=2)
        stage.error("bad", id=3)
        raise RuntimeError("x")
    events = [json.loads(x) for x in log.read_text().splitlines()]
    assert [e["event"] for e in events] == ["run_start", "stage_start", "error", "stage_end", "run_end"] and events[3]["items"] == 2 and events[3]["failed"]


def test_stream_rerun_adds_nothing(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.range(10).write.parquet(src)
    keep = lambda df: df.filter("id % 2 = 0")
    schema = spark.read.parquet(src).schema
    ingest.ingest(spark, src, schema, keep, out, mark)
    ingest.ingest(spark, src, schema, keep, out, mark)
    assert spark.read.parquet(out).count() == 5
    spark.range(10, 20).write.mode("append").parquet(src)
    ingest.ingest(spark, src, schema, keep, out, mark)
    assert spark.read.parquet(out).count() == 10


def test_raw_documents_and_jsonl(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.html").write_bytes(b"a\xff")
    r = tables.raw_documents(spark, str(tmp_path / "d")).first()
    assert r["text"] == "a�" and r["length"] == 2 and len(r["sha256"]) == 64
    n = sinks.report({"t": spark.range(2), "n": 1}, str(tmp_path / "r.json"))
    assert n and json.loads((tmp_path / "r.json").read_text())["t"] == [{"id": 0}, {"id": 1}]
