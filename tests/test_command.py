"""The command line from a manifest file to a report file."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from corpusloom import __main__ as cli
from corpusloom import schemas as s
from corpusloom.functions import text as tx
from corpusloom.operators import chunks as ck
from corpusloom.operators import discover
from corpusloom.sources import fetch as ft
from corpusloom.sources import http, sinks

WORDS = {
    "u/one": "The kiln at Vellmar fired ninety bricks on the first day of the dry season and none of them cracked.",
    "u/two": "Harbour dues rose to forty crowns a mast after the second bridge had been opened to carts.",
    "u/note": "A note on glazing says that ash of beech gives a green coat.",
}


class Wire:
    """Answers of a made-up archive, and the addresses asked for."""

    def __init__(self):
        self.asked = []

    def __call__(self, url, headers, timeout):
        self.asked.append(url)
        if url == "u/gone":
            return 404, {}, b""
        if url == "u/picture":
            return 200, {"Content-Type": "image/png"}, b"\x89"
        return 200, {"Content-Type": "text/html; charset=utf-8"}, f"<html><body><p>{WORDS[url]}</p></body></html>".encode()


@pytest.fixture
def place(spark, tmp_path):
    row = lambda n, kind, doc, url: ("0000000009", "KLN", f"0000000009-31-00000{n}", "8-K", "2031-04-05", None, kind, "EX-99.1" if kind == "exhibit" else None, doc, url)
    rows = [row(1, "primary", "one.htm", "u/one"), row(1, "exhibit", "note.htm", "u/note"), row(2, "primary", "two.htm", "u/two"), row(3, "primary", "gone.htm", "u/gone"), row(4, "primary", "p.png", "u/picture"), row(5, "primary", None, None)]
    sinks.manifest(spark.createDataFrame(rows, s.MANIFEST), str(tmp_path / "manifest.csv"))
    key = [
        {"id": "k1", "type": "single_fact", "question": "How many bricks did the kiln at Vellmar fire?", "ground_truth": {"ticker": "KLN", "accession": "0000000009-31-000001", "quote": "fired ninety bricks"}},
        {"id": "k2", "type": "negative_control", "question": "Who painted the ceiling?", "ground_truth": None},
        {"id": "k3", "type": "single_fact", "question": "", "ground_truth": None},
    ]
    (tmp_path / "key.yaml").write_text(yaml.safe_dump(key))
    paths = {n: str(tmp_path / f) for n, f in {"manifest": "manifest.csv", "store": "store", "ledger": "ledger", "index": "index", "key": "key.yaml", "report": "report.json", "log": "log.jsonl"}.items()}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"paths": paths, "http": {"agent": "tests", "rate": 1000, "allowed": ["text/html"]}, "window": {"size": 60, "overlap": 10}, "sections": {"least": 20}}))
    return tmp_path


def run(spark, capsys, place, stage, *more, **given):
    state = cli.main([stage, "--config", str(place / "c.yaml"), *more], spark=spark, **given)
    out = capsys.readouterr().out.splitlines()
    return state, [json.loads(x) for x in out]


def test_from_manifest_to_report(spark, capsys, place):
    wire = Wire()
    client = http.Client("tests", rate=1000, opener=wire)
    assert run(spark, capsys, place, "fetch", "--dry-run") == (0, [{"stage": "fetch", "outstanding": 5}])
    state, told = run(spark, capsys, place, "fetch", "--limit", "1", client=client)
    assert state == 0 and told[0] == {"stage": "fetch", "ok": 1, "error": 0, "unaddressed": 1} and wire.asked == ["u/one"]
    state, told = run(spark, capsys, place, "fetch", client=client)
    assert state == 1 and told[0] == {"stage": "fetch", "ok": 2, "error": 2, "unaddressed": 1} and wire.asked.count("u/one") == 1
    assert sorted(p.name for p in (place / "store").iterdir()) == ["000000000931000001-note.html", "000000000931000001.html", "000000000931000002.html"]
    run(spark, capsys, place, "fetch", client=client)  # failures are tried again, what is there is not
    assert wire.asked.count("u/two") == 1 and wire.asked.count("u/gone") == 2
    (place / "store" / "000000000931000002.html").write_bytes(b"cut")
    run(spark, capsys, place, "fetch", client=client)
    assert wire.asked.count("u/two") == 2
    run(spark, capsys, place, "fetch", "--force", "--limit", "2", client=client)
    assert wire.asked.count("u/one") == 2 and wire.asked.count("u/note") == 2
    last = {(r["document"], r["status"]) for r in ft.ledger_of(spark, str(place / "ledger")).collect()}
    assert last == {("one.htm", "ok"), ("note.htm", "ok"), ("two.htm", "ok"), ("gone.htm", "error"), ("p.png", "error")}

    state, told = run(spark, capsys, place, "index")
    assert state == 1 and told[0]["missing"] == 3 and told[0]["refused"] == 0 and told[0]["chunks"] > 3
    assert run(spark, capsys, place, "index")[1][0]["chunks"] == told[0]["chunks"]
    assert run(spark, capsys, place, "index", "--set", "window.size=50")[0] == 2  # another chunking
    (place / "q.txt").write_text("# asked\nharbour dues\n\nash of beech\n")
    for kind in ("lexical", "dense", "hybrid"):
        state, found = run(spark, capsys, place, "search", "--query-file", str(place / "q.txt"), "--top-k", "2", "--kind", kind)
        assert state == 0 and found[-1]["hits"] == len(found) - 1 and {h["rank"] for h in found[:-1]} <= {1, 2}
    _, found = run(spark, capsys, place, "search", "--query", "harbour dues", "--kind", "lexical")
    assert found[0]["document"] == "two.htm"

    state, told = run(spark, capsys, place, "evaluate", "--kind", "lexical")
    report = json.loads((place / "report.json").read_text())
    assert state == 1 and told[0] == {"stage": "evaluate", "questions": 3, "rejected": 1, "unresolved": 0}
    assert [r["qid"] for r in report["rejected"]] == ["k3"] and report["single_fact"][0]["top1_correct"] and report["single_fact"][0]["citation_correct"] is not None
    assert run(spark, capsys, place, "evaluate", "--only", "k1", "--json-only") == (0, [])
    assert [r["qid"] for r in json.loads((place / "report.json").read_text())["single_fact"]] == ["k1"]
    events = [json.loads(x) for x in (place / "log.jsonl").read_text().splitlines()]
    assert any(e["event"] == "error" and e.get("context", {}).get("document") == "gone.htm" for e in events)
    assert run(spark, capsys, place, "fetch", "--set", "paths.manifest=/nowhere/m.csv")[0] == 2


def test_foreign_prefixes_stop_a_build(spark):
    rows = spark.createDataFrame([("passage: x",), (" query: y",)], "t string")
    kept = rows.select(tx.refuse_foreign(F.col("t"), ["query:"]).alias("t"))
    with pytest.raises(Exception, match="foreign prompt prefix"):
        kept.collect()
    assert [r[0] for r in rows.select(tx.refuse_foreign(F.col("t"), ["search_document:"])).collect()] == ["passage: x", " query: y"]


def test_commonest_labels(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "l string")
    assert [(r["l"], r["n"], r["place"]) for r in ck.most_common(rows, "l").orderBy("place").collect()] == [("c", 2, 1), (None, 1, 2), ("a", 1, 3), ("b", 1, 4)]
    assert ck.most_common(rows.limit(0), "l").count() == 0


def test_one_manifest_of_all_sources(spark):
    filing = lambda a, day, doc, seq: ("9", "KLN", f"00000000093100000{a}", "8-K", day, "2031-01-01", doc, seq)
    names = "cik string, ticker string, accessionNumber string, form string, filingDate string, reportDate string, primaryDocument string, seq long"
    recent = spark.createDataFrame([filing(1, "2031-02-03", "one.htm", 0)], names)
    shards = spark.createDataFrame([filing(1, "2031-02-03", "late.htm", 0), filing(2, "2031-01-09", "two.htm", 1)], names)
    heads = spark.createDataFrame([("0000000009-31-000001", "EX-99.1", "2", "one.htm"), ("0000000009-31-000002", "EX-99.2", "2", "x.htm"), ("0000000009-31-000002", "EX-99.3", "3", None)], "accession string, type string, sequence string, filename string")
    rows, problems = discover.discover(recent, shards, heads, "https://x", ["8-K"], ["EX-99"], "2031-01-01", "2031-12-31")
    assert rows.columns == s.MANIFEST.fieldNames()
    assert [(r["accession"][-1], r["doc_type"], r["document"]) for r in discover.manifest_order(rows).collect()] == [("1", "primary", "one.htm"), ("2", "primary", "two.htm"), ("2", "exhibit", "x.htm")]
    assert {r["problem"] for r in problems.collect()} == {"exhibit without a file name"}
    none, _ = discover.discover(recent.limit(0), shards.limit(0), heads, "https://x", ["8-K"], ["EX-99"], "2031-01-01", "2031-12-31")
    assert none.count() == 0
