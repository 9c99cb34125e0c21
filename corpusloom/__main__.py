"""The command line: ``python -m corpusloom STAGE --config FILE``.

Stages: fetch, index, search, evaluate. A stage prints one line of JSON with its
counts and ends with 1 if any row was rejected, 2 if it could not run.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from contextlib import nullcontext

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, RunLog
from .functions.windows import CharWindows, TokenWindows
from .operators import resolve, score
from .plans import build
from .sources import fetch as ft
from .sources import http, sinks, tables


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__.splitlines()[0])
    stages = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, told: str) -> argparse.ArgumentParser:
        p = stages.add_parser(name, help=told)
        p.add_argument("--config", required=True, help="YAML file")
        p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="replace one value of the configuration")
        return p

    p = stage("fetch", "documents of the manifest to files and the ledger")
    p.add_argument("--limit", type=int, help="only the first N outstanding rows")
    p.add_argument("--force", action="store_true", help="also what is there already")
    p.add_argument("--dry-run", action="store_true", help="count what would be fetched")
    p = stage("index", "fetched documents to chunks, vectors and postings")
    p.add_argument("--limit", type=int, help="only the first N chunks")
    p.add_argument("--rebuild", action="store_true", help="replace the index")
    p.add_argument("--dry-run", action="store_true", help="count the documents")
    p = stage("search", "hits of one query or of a file of queries, a line of JSON each")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--query")
    which.add_argument("--query-file")
    p.add_argument("--top-k", type=int, default=20)
    p.add_argument("--kind", choices=["lexical", "dense", "hybrid"], default="hybrid")
    p = stage("evaluate", "the answer key against the index")
    p.add_argument("--only", action="append", metavar="ID", help="only this entry of the key")
    p.add_argument("--top-k", type=int, default=20)
    p.add_argument("--kind", choices=["lexical", "dense", "hybrid"], default="hybrid")
    p.add_argument("--json-only", action="store_true", help="write the report, print nothing")
    return top.parse_args(given)


def windows(c: Config):
    kind = {"characters": CharWindows, "tokens": TokenWindows}[c.get("window.unit", "characters")]
    return kind(int(c.get("window.size", 2000)), int(c.get("window.overlap", 200)))


def retriever(spark: SparkSession, c: Config) -> build.Retriever:
    return build.Retriever(spark, c.get("paths.index"), c.get("embedder.name", "hashing"), c.get("embedder.options", {}))


def do_fetch(spark, c: Config, a, log, client=None) -> tuple[dict, bool]:
    rows, store = tables.manifest(spark, c.get("paths.manifest")), c.get("paths.store")
    if a.dry_run:
        return {"outstanding": ft.pending(rows, ft.ledger_of(spark, c.get("paths.ledger")), store, a.limit, a.force).count()}, True
    client = client or http.Client(c.get("http.agent"), rate=c.get("http.rate", 8))
    counts = ft.fetch(rows, store, c.get("paths.ledger"), client, c.get("http.allowed", None), a.limit, a.force, c.get("http.every", 50), log)
    return counts, not counts["error"]


def do_index(spark, c: Config, a, log) -> tuple[dict, bool]:
    good, rest = ft.fetched(tables.manifest(spark, c.get("paths.manifest")), ft.ledger_of(spark, c.get("paths.ledger")), c.get("paths.store"))
    missing = rest.count()
    if a.dry_run:
        return {"documents": good.count(), "missing": missing}, not missing
    rows, long_ = build.build_index(good, c.get("paths.index"), windows(c), c.get("anchors", {}), c.get("embedder.name", "hashing"), c.get("embedder.options", {}), c.get("sections.least", 200), c.get("sections.preamble", None), a.limit, a.rebuild, c.get("embedder.foreign_prefixes", []))
    counts = {"chunks": rows.count(), "refused": long_.count(), "missing": missing}
    log.count(items=counts["chunks"])
    return counts, not (missing or counts["refused"])


def do_search(spark, c: Config, a, log) -> tuple[dict, bool]:
    asked = tables.questions(spark, a.query_file) if a.query_file else spark.createDataFrame([(0, a.query)], "qid long, text string")
    n = 0
    for hit in retriever(spark, c).search(asked.select("qid", "text"), a.top_k, a.kind).orderBy("qid", "rank").toLocalIterator():
        print(json.dumps(hit.asDict(), default=str, ensure_ascii=False))
        n += 1
    log.count(items=n)
    return {"hits": n}, True


def do_evaluate(spark, c: Config, a, log) -> tuple[dict, bool]:
    entries, truths = tables.load_key(spark, c.get("paths.key"))
    entries, truths = score.only(entries, a.only), score.only(truths, a.only)
    r = retriever(spark, c)
    hits = r.search(entries.filter(F.coalesce("question", F.lit("")) != "").select("qid", F.col("question").alias("text")), a.top_k, a.kind).persist()
    found = resolve.resolve(truths, resolve.normalised(r.rows)).persist()
    parts = score.evaluate(entries, hits, found, section_tickers=c.get("sections.tickers", []))
    sinks.report(parts, c.get("paths.report"))
    counts = {"questions": entries.count(), "rejected": parts["rejected"].count(), "unresolved": parts["unresolved"].count()}
    for row in parts["rejected"].toLocalIterator():
        log.error("an entry without a question", qid=row["qid"])
    log.count(items=counts["questions"])
    return counts, not (counts["rejected"] or counts["unresolved"])


def main(given: list[str] | None = None, spark: SparkSession | None = None, **more) -> int:
    """Run one stage; its exit state. A session of the caller's stays open."""
    a = arguments(given)
    own = None
    try:
        c = Config.load(a.config, a.set)
        session = spark or (own := SparkSession.builder.appName(f"corpusloom {a.stage}").getOrCreate())
        with RunLog(c.get("paths.log", os.devnull)) as run, run.stage(a.stage) as log:
            counts, good = globals()[f"do_{a.stage}"](session, c, a, log, **more)
    except (KeyError, ValueError, OSError, AnalysisException) as e:
        print(f"{a.stage}: {e}", file=sys.stderr)
        return 2
    finally:
        with own or nullcontext():
            pass
    if not getattr(a, "json_only", False):
        print(json.dumps({"stage": a.stage} | counts))
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
