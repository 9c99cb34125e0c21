"""Queries of the control path: ledgers, discovery, audits and scores over whole test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, ledgers, resolve, score
from ..operators import chunks as ck
from ..operators import discover as dc
from ..sources import tables
from .queries import ARCHIVE, _t, query


def _as_ledger(spark, d):
    """Events as a ledger of documents (user, type), in the order of their ids."""
    k = F.col("event_id")
    return _t(spark, d, "events").select(
        F.col("user_id").cast("string").alias("accession"), F.col("event_type").alias("document"), F.lit("primary").alias("doc_type"), F.concat(F.lit("store\\"), k).alias("path"),
        F.when(k % 3 == 0, "error").otherwise("ok").alias("status"), (k % 10).cast("string").alias("bytes"), F.concat(F.lit("sha"), k % 5).alias("sha256"), k.alias("seq"),
    )


_LAST = "last AS (SELECT * FROM (SELECT user_id, event_type, event_id AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)"


@query(f"WITH {_LAST} SELECT user_id::VARCHAR AS accession, event_type AS document FROM last WHERE k % 3 = 0 OR k % 7 = 0")
def fetch_outstanding(spark, d):
    """Every seventh file has another length than the ledger says."""
    led = _as_ledger(spark, d)
    k = F.col("seq")
    files = led.select(F.concat(F.lit("store/"), k).alias("path"), F.when(k % 7 == 0, -1).otherwise(k % 10).alias("length"))
    return ledgers.to_fetch(led.select("accession", "document").distinct(), led, files)


@query(f"WITH {_LAST} SELECT user_id::VARCHAR AS accession, event_type AS document FROM last WHERE k % 4 = 0 OR k % 5 <> 1 OR k % 11 = 0")
def parse_outstanding(spark, d):
    """Documents of another configuration, another digest, or whose output is gone."""
    led = _as_ledger(spark, d)
    k = F.col("seq")
    parsed = led.select("accession", "document", F.col("sha256").alias("doc_sha256"), F.when(k % 4 == 0, "old").otherwise("new").alias("config_fingerprint"), "path", "seq")
    documents = led.select("accession", "document").distinct().withColumn("doc_sha256", F.lit("sha1"))
    return ledgers.to_parse(documents, parsed, "new", led.filter(k % 11 != 0).select("path")).select("accession", "document")


@query(f"""WITH {_LAST}, m AS (SELECT c_custkey::VARCHAR AS accession, t AS document FROM customer, (SELECT unnest(['click', 'signup', NULL]) AS t))
    SELECT m.accession, coalesce(m.document, '') AS document, coalesce(k % 3 <> 0, false) AS available, CASE WHEN k % 3 <> 0 THEN 'sha' || (k % 5) END AS sha256
    FROM m LEFT JOIN last ON m.accession = user_id::VARCHAR AND coalesce(m.document, '') = event_type""")
def available_documents(spark, d):
    kinds = F.explode(F.array(F.lit("click"), F.lit("signup"), F.lit(None)))
    rows = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("accession"), kinds.alias("document"))
    good, rest = ledgers.split_available(rows, _as_ledger(spark, d))
    name = F.coalesce("document", F.lit("")).alias("document")
    good = good.select("accession", name, F.lit(True).alias("available"), "sha256")
    return good.unionByName(rest.select("accession", name, F.lit(False).alias("available"), F.lit(None).cast("string").alias("sha256")))


@query("""WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'd' || (o_orderkey % 4) END AS doc FROM orders)
    SELECT o.o_orderkey AS id, 'd' || (o.o_orderkey % 2) AS document, CASE WHEN l.doc = 'd' || (o.o_orderkey % 2) OR (l.doc = '' AND o.o_orderkey % 5 <> 0) THEN 'p' || o.o_orderkey END AS path
    FROM orders o JOIN l USING (o_orderkey)""")
def ledger_fallback(spark, d):
    """A primary without an entry of its own takes the one without a document."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders")
    manifest = o.select(k.cast("string").alias("accession"), F.concat(F.lit("d"), k % 2).alias("document"), F.when(k % 5 == 0, "exhibit").otherwise("primary").alias("doc_type"))
    led = o.select(k.cast("string").alias("accession"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("d"), k % 4)).alias("document"), F.concat(F.lit("p"), k).alias("path"), F.lit("ok").alias("status"), F.lit("1").alias("bytes"))
    return audit.ledger_lookup(manifest, led).select(F.col("accession").cast("long").alias("id"), "document", F.col("entry.path").alias("path"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN o_orderkey IS NOT NULL AND o_orderstatus <> 'F' THEN 'doc' || o_orderkey ELSE '' END AS document
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def legacy_primaries(spark, d):
    old = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("accession"), "l_linenumber")
    kind = F.when(F.col("o_orderstatus") == "F", "exhibit").when(F.col("o_orderstatus") == "O", "primary")
    known = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("accession"), F.concat(F.lit("doc"), "o_orderkey").alias("document"), kind.alias("doc_type"))
    return ledgers.migrate(old, known).select(F.col("accession").cast("long").alias("id"), F.col("l_linenumber").alias("line"), "document")


@query("SELECT p_partkey, p_type, starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'PROMO') AS fits FROM part")
def exhibit_types(spark, d):
    shown = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.concat(F.lit(" "), "p_type"))
    return _t(spark, d, "part").select("p_partkey", "p_type", tx.is_exhibit_type(shown, [" economy", "Promo", ""]).alias("fits"))


@query("""SELECT event_id, event_id % 4 <> 2 AS allowed, CASE WHEN event_id % 4 = 1 THEN '.txt' ELSE '.html' END AS extension FROM events""")
def media_types(spark, d):
    k = F.col("event_id")
    kind = F.when(k % 4 == 0, "Text/HTML; charset=utf-8").when(k % 4 == 1, "text/plain").when(k % 4 == 2, "application/pdf").otherwise("")
    return _t(spark, d, "events").select("event_id", tx.allowed_type(kind, ["text/html", "TEXT/PLAIN"]).alias("allowed"), tx.extension_of(kind).alias("extension"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS row FROM events")
def row_numbers(spark, d):
    return tables.numbered(_t(spark, d, "events"), "event_type", "ts", "event_id").select("event_id", "row")


@query("""SELECT p_type AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type""")
def commonest_labels(spark, d):
    return ck.most_common(_t(spark, d, "part").select(F.col("p_type").alias("label")), "label")


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 = 1 THEN ' ' ELSE 'EX-' || p_size END AS kind FROM part)
    SELECT p_partkey, coalesce(upper(trim(p.kind)), '') AS kind, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'f' || p_partkey || '.htm' END AS filename FROM p
    WHERE p_partkey % 4 <> 0 OR trim(coalesce(kind, '')) <> ''""")
def index_header_documents(spark, d):
    """Index headers made from parts: one or no type, one or no file name, escaped brackets."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(size % 6 == 0, "").when(size % 6 == 1, "&lt;TYPE&gt; \n").otherwise(F.concat(F.lit("&lt;type&gt;EX-"), size, F.lit(" \r\n")))
    name = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("&lt;FILENAME&gt;f"), k, F.lit(".htm\n")))
    pages = _t(spark, d, "part").select(k.cast("string").alias("accession"), F.concat(F.lit("<PRE>&lt;DOCUMENT&gt;\n"), kind, name, F.lit("&lt;DOCUMENT&gt;\n&lt;/SEC-HEADER&gt;")).alias("payload"))
    return tables.index_headers(pages).select(F.col("accession").cast("long").alias("p_partkey"), F.upper(F.coalesce("type", F.lit(""))).alias("kind"), "filename")


_FILED = "SELECT *, lpad(o_orderkey::VARCHAR, 10, '0') || '-96-000001' AS accession FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'"


def _filings(spark, d):
    k = F.col("o_orderkey")
    bare = F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("96000001"))
    return _t(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("cik"), F.col("o_orderpriority").alias("ticker"), bare.alias("accessionNumber"), F.concat(F.lit(" "), "o_orderstatus").alias("form"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.when(k % 3 == 0, "").otherwise("1995-01-01").alias("reportDate"), F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit("d"), k)).alias("primaryDocument"), k.alias("seq"),
    )


@query(f"""WITH f AS ({_FILED}) SELECT accession, o_orderstatus AS form, CASE WHEN o_orderkey % 3 <> 0 THEN '1995-01-01' END AS period_of_report, CASE WHEN o_orderkey % 5 <> 0 THEN 'd' || o_orderkey END AS document,
    CASE WHEN o_orderkey % 5 <> 0 THEN '{ARCHIVE}/edgar/data/' || o_custkey || '/' || replace(accession, '-', '') || '/d' || o_orderkey END AS doc_url FROM f""")
def filings_to_manifest(spark, d):
    rows, _ = dc.manifest_rows(_filings(spark, d), ARCHIVE, ["O", "P"], "1995-01-01", "1997-12-31")
    return rows.select("accession", "form", "period_of_report", "document", "doc_url")


@query(f"""WITH f AS ({_FILED}) SELECT problem, count(*) AS n FROM
    (SELECT 'no primaryDocument' AS problem FROM f WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'no reportDate' FROM f WHERE o_orderkey % 3 = 0) GROUP BY problem""")
def filing_problems(spark, d):
    _, problems = dc.manifest_rows(_filings(spark, d), ARCHIVE, ["O", "P"], "1995-01-01", "1997-12-31")
    return problems.groupBy("problem").agg(F.count("*").alias("n"))


_EXHIBITS = f"""f AS ({_FILED}), x AS (SELECT accession, 'EX-' || l_linenumber AS exhibit_label, CASE WHEN l_linenumber <> 3 THEN 'x' || l_partkey || '_' || l_linenumber || '.htm' END AS document, l_linenumber
    FROM f JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 2, 3))"""


def _headers(spark, d):
    line = F.col("l_linenumber")
    accession = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("-96-000001"))
    name = F.when(line != 3, F.concat(F.lit("x"), "l_partkey", F.lit("_"), line, F.lit(".htm")))
    return _t(spark, d, "lineitem").select(accession.alias("accession"), F.concat(F.lit("EX-"), line).alias("type"), line.cast("string").alias("sequence"), name.alias("filename"), F.lit(None).cast("string").alias("description"))


@query(f"WITH {_EXHIBITS} SELECT accession, exhibit_label, document FROM x WHERE document IS NOT NULL")
def exhibits_of_filings(spark, d):
    primaries, _ = dc.manifest_rows(_filings(spark, d), ARCHIVE, ["O", "P"], "1995-01-01", "1997-12-31")
    named, _ = dc.exhibit_rows(primaries, _headers(spark, d), ARCHIVE, ["EX-1", "EX-2", "EX-3"])
    return named.select("accession", "exhibit_label", "document")


@query(f"""WITH {_EXHIBITS}, m AS (SELECT o_orderpriority AS ticker, 'primary' AS doc_type FROM f UNION ALL
    SELECT o_orderpriority, 'exhibit' FROM f JOIN (SELECT DISTINCT accession, document FROM x WHERE document IS NOT NULL) USING (accession))
    SELECT ticker, doc_type, count(*) AS n FROM m GROUP BY ALL""")
def discovered_counts(spark, d):
    """Recent filings, shards and exhibits as one manifest; the shards repeat every other filing."""
    filings = _filings(spark, d)
    found, _ = dc.discover(filings.filter("seq % 3 > 0"), filings.filter("seq % 3 = 0 or seq % 2 = 0"), _headers(spark, d), ARCHIVE, ["O", "P"], ["EX-1", "EX-2", "EX-3"], "1995-01-01", "1997-12-31")
    return found.groupBy("ticker", "doc_type").agg(F.count("*").alias("n"))


_NOTES = "a AS (SELECT doc_id, text, length(regexp_extract(text, '(?is)^(.*?)an [a-z]', 1)) AS first, regexp_matches(text, '(?i)an [a-z]') AS has FROM documents), b AS (SELECT *, substr(text, first + 1) AS rest FROM a)"


@query(f"""WITH {_NOTES} SELECT doc_id, CASE WHEN coalesce(has, false) THEN length(regexp_replace(CASE WHEN regexp_matches(rest, '(?i)then') THEN regexp_extract(rest, '(?is)^(.*)then', 1) ELSE rest END, '^\\s+|\\s+$', '', 'g')) ELSE 0 END AS chars,
    list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '(?i)an ([a-z])', 1)))::VARCHAR AS codes FROM b""")
def narrative_lengths(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", audit.narrative(F.col("text"), "an ([a-z])", "then").alias("n"))
    return rows.select("doc_id", "n.chars", F.concat(F.lit("["), F.concat_ws(", ", "n.items"), F.lit("]")).alias("codes"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '(?i)th[a-z]'))), ' ') AS codes FROM documents")
def referenced_codes(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.concat_ws(" ", audit.labels(F.col("text"), "th[a-z]")).alias("codes"))


@query("""WITH p AS (SELECT o_orderkey, count(*) AS refs, count(*) FILTER (l_linenumber % 2 = 0) AS open, bool_or(l_returnflag = 'R') AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 WHERE o_orderstatus = 'O' GROUP BY o_orderkey),
    q AS (SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) THEN refs ELSE 0 END AS refs, open, coalesce(r, false) AS r FROM p)
    SELECT count(*) AS primary_documents, count(*) FILTER (refs > 0) AS referencing, count(*) FILTER (open > 0) AS with_unresolved, count(*) FILTER (refs > 0) - count(*) FILTER (open > 0) AS resolved,
    count(*) FILTER (r) AS item_2_02, count(*) FILTER (r AND open > 0) AS item_2_02_with_unresolved FROM q""")
def exhibit_funnel(spark, d):
    lines = _t(spark, d, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    line, none = F.col("l_linenumber").cast("string"), F.array().cast("array<string>")
    item = F.when(F.col("l_returnflag") == "R", "2.02").otherwise("1.01")
    lines = lines.agg(F.collect_list(line).alias("refs"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, line)).alias("open"), F.collect_set(item).alias("items"))
    form = F.when(F.col("o_orderstatus") == "O", "8-K").otherwise("10-Q")
    rows = _t(spark, d, "orders").join(lines, "o_orderkey", "left").select(form.alias("form"), F.lit("primary").alias("doc_type"), F.coalesce("refs", none).alias("exhibits_referenced"), F.coalesce("open", none).alias("exhibits_unresolved"), F.coalesce("items", none).alias("items"))
    return audit.funnel(rows)


_RANKED = "h AS (SELECT user_id AS qid, event_type AS section, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events)"


def _ranked(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("section"), F.col("event_id").cast("string").alias("chunk_id"), rank.alias("rank"))


@query(f"""WITH {_RANKED} SELECT qid, section AS observed, section IN ('click', 'signup') AS correct FROM h WHERE rank = 1 AND qid % 3 = 0""")
def section_accuracy(spark, d):
    hits = _ranked(spark, d)
    ticker = F.concat(F.lit("t"), F.col("qid") % 3)
    goals = hits.select("qid").distinct().select("qid", ticker.alias("ticker"), F.array(F.lit("signup"), F.lit("click")).alias("sections"))
    return score.section_result(hits, goals.unionByName(goals), ["t0"]).select("qid", "observed", "correct")


@query(f"""WITH {_RANKED}, m AS (SELECT qid, event_id % 3 AS member, min(rank) FILTER (event_id % 5 = 0) AS rank FROM h GROUP BY ALL)
    SELECT qid, bool_and(coalesce(rank <= 5, false)) AS recall_at_5, count(*) FILTER (rank <= 5) AS covered_at_5, bool_and(coalesce(rank <= 20, false)) AS recall_at_20, count(*) FILTER (rank <= 20) AS covered_at_20, count(*) AS members_total,
    greatest(qid % 4, 1) AS max_corpus_accessions, qid % 4 <= 1 AND qid % 3 <= 1 AS meaningful FROM m GROUP BY qid""")
def target_recall(spark, d):
    """Targets of a member: every fifth event among its own."""
    hits = _ranked(spark, d)
    member, goal = F.col("chunk_id").cast("long") % 3, F.when(F.col("chunk_id").cast("long") % 5 == 0, F.col("chunk_id"))
    goals = hits.groupBy("qid", member.alias("member")).agg(F.collect_list(goal).alias("chunk_ids"))
    goals = goals.select("*", F.lit("a").alias("accession"), F.lit("d").alias("document"), (F.col("qid") % 4).alias("corpus_accessions"), (F.col("qid") % 3).alias("duplicate_text_count"))
    return score.target_recall(hits, goals).drop("max_duplicate_text_count", "not_meaningful_because")


@query("""SELECT item_id::VARCHAR AS qid, CASE WHEN item_id % 2 = 0 THEN 'negative_control' ELSE 'ground_truth_unwritten' END AS status FROM benchmark WHERE item_id % 3 <> 1""")
def unwritten_truths(spark, d):
    b, q = _t(spark, d, "benchmark"), F.col("item_id").cast("string").alias("qid")
    entries = b.select(q, F.when(F.col("item_id") % 2 == 0, "negative_control").otherwise("single_fact").alias("type"))
    return resolve.unwritten(entries, b.filter("item_id % 3 = 1").select(q))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, starts_with(ltrim(t, chr(9) || chr(10) || chr(13) || ' '), 'The') OR starts_with(ltrim(t, chr(9) || chr(10) || chr(13) || ' '), 'An') AS foreign_prefix FROM d""")
def foreign_prefixes(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.starts_with_foreign(F.coalesce("text", F.lit("")), ["The", "An"]).alias("foreign_prefix"))
