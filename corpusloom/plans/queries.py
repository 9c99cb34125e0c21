"""Queries over the test tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..embedders import embed
from ..functions import text as tx
from ..functions import windows as w
from ..functions.html import visible
from ..operators import audit, dense, fusion, ledgers, lexical, resolve, score
from ..operators import chunks as ck
from ..operators import discover as dc

_known: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
ARCHIVE = "https://archive.example/Archives"
#: Anchors for invented prose, which has no headings: sentences that begin with an article.
ANCHORS = {
    "en": [{"label": "the", "pattern": r"\bThe\b"}, {"label": "an_{0}", "pattern": r"\bAn ([a-z]+)"}],
    "_default": [{"label": "line", "pattern": r"\n"}],
}


def query(sql: str | None = None):
    def add(f):
        _known[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("row"), "text")


def _questions(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _chunks(spark, d):
    """Documents in the shape of chunks."""
    t = _t(spark, d, "documents")
    section = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3))
    return t.select(
        F.col("doc_id").alias("row"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("ticker"), F.col("source").alias("accession"),
        F.concat(F.lit("d"), "doc_id").alias("document"), F.lit("primary").alias("doc_type"), section.alias("section"), F.col("lang").alias("form"), F.lit("").alias("filing_date"), "text",
    )


def _truths(spark, d):
    """Every benchmark passage as a truth of the whole corpus, and scoped to one source."""
    b = _t(spark, d, "benchmark")
    wide = b.select(F.col("item_id").alias("qid"), F.lit(0).alias("member"), F.lit(None).cast("string").alias("ticker"), F.lit("ANY").alias("accession"), F.lit(None).cast("string").alias("document"), F.col("text").alias("quote"))
    scoped = wide.withColumns({"member": F.lit(1), "accession": F.concat(F.lit("src"), (F.col("qid") % 23).cast("string"))})
    return wide.unionByName(scoped)


_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[.,][a-z0-9]+)*%?')"
_BM25 = f"""
    d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
    st AS (SELECT count(*) AS n, coalesce(avg(len(t)), 0) AS avgdl FROM d),
    tf AS (SELECT doc_id, len(t) AS dl, u.term, count(*) AS tf FROM d, unnest(t) AS u(term) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term),
    q0 AS (SELECT item_id AS qid, {_TOKENS} AS t FROM benchmark),
    q1 AS (SELECT qid, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM q0),
    q AS (SELECT qid, term, min(i) AS place FROM q1 GROUP BY ALL),
    sc AS (SELECT qid, doc_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ORDER BY place) AS score
           FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY ALL),
    bm AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc)"""
_DENSE = """
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    de AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, list_inner_product(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 20 = 0),
    dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM de)"""


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def token_stats(spark, d):
    t = tx.tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM df")
def postings_df_idf(spark, d):
    return lexical.build(_docs(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, d):
    return lexical.build(_docs(spark, d)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, d, top=20):
    return lexical.best(_docs(spark, d), _questions(spark, d), top)


@query(f"WITH {_BM25} SELECT qid, rank, doc_id, round(score, 6) AS score FROM bm WHERE rank <= 20")
def bm25_top20(spark, d):
    return _bm25(spark, d).select("qid", "rank", F.col("row").alias("doc_id"), F.round("score", 6).alias("score"))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding")


def _asked(spark, d):
    return _vectors(spark, d).filter("row % 20 = 0").withColumnRenamed("row", "qid")


@query(f"WITH {_DENSE} SELECT qid, rank, doc_id AS vec_id, round(score, 5) AS score FROM dr WHERE rank <= 20")
def dense_top20(spark, d):
    return dense.search(_vectors(spark, d), _asked(spark, d), 20).select("qid", "rank", F.col("row").alias("vec_id"), F.round("score", 5).alias("score"))


@query(f"""WITH {_DENSE}, r2 AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY abs(qid - doc_id), doc_id) AS rank FROM de),
    f AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT qid, doc_id, rank FROM dr UNION ALL SELECT * FROM r2) GROUP BY ALL)
    SELECT * FROM (SELECT qid, doc_id AS vec_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank, round(s, 8) AS score FROM f) WHERE rank <= 20""")
def rrf_two_rankings(spark, d):
    fused = fusion.rrf_of_scores(_vectors(spark, d), _asked(spark, d), [dense.InnerProduct, fusion.NearestId], 20)
    return fused.select("qid", F.col("row").alias("vec_id"), "rank", F.round("score", 8).alias("score"))


@query(f"""WITH {_BM25}, {_DENSE}, f AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s
        FROM (SELECT qid, doc_id, rank FROM dr UNION ALL SELECT qid, doc_id, rank FROM bm WHERE qid % 20 = 0) GROUP BY ALL)
    SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank, round(s, 8) AS score FROM f) WHERE rank <= 20""")
def hybrid_top20(spark, d):
    q = _questions(spark, d).filter("qid % 20 = 0")
    return fusion.hybrid_by_scans(_docs(spark, d), q, _vectors(spark, d), _asked(spark, d), 20).select("qid", F.col("row").alias("doc_id"), "rank", F.round("score", 8).alias("score"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) = 0 THEN 0 ELSE 1 + greatest(0, ceil((length(text) - 500) / 400.0))::INT END AS c FROM documents),
    e AS (SELECT doc_id, text, n, unnest(range(c)) AS i FROM d)
    SELECT 'doc' || doc_id || '::' || lpad(i::VARCHAR, 5, '0') AS chunk_id, i AS ordinal, i * 400 AS "start", least(i * 400 + 500, n) AS "end", substring(text, i * 400 + 1, 500) AS body FROM e""")
def char_windows(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "text", F.posexplode(w.plain_windows(F.length("text"), 500, 100)).alias("ordinal", "x"))
    ident = tx.chunk_id(F.concat(F.lit("doc"), "doc_id"), F.lit(None), F.col("ordinal"))
    return rows.select(ident.alias("chunk_id"), "ordinal", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.substring("text", F.col("x.start") + 1, F.col("x.n")).alias("body"))


_WS = r"trim(regexp_replace({}, '[\s\x1c-\x1f]+', ' ', 'g'))"
_RESOLVE = rf"""
    c AS (SELECT doc_id AS r, source AS a, {_WS.format('text')} AS norm, CASE WHEN doc_id % 3 > 0 THEN 's' || doc_id % 3 ELSE 'None' END AS section FROM documents),
    cd AS (SELECT *, count(*) OVER (PARTITION BY norm) AS dup FROM c),
    tr AS (SELECT item_id AS qid, 0 AS member, 'ANY' AS accession, {_WS.format('text')} AS needle FROM benchmark
           UNION ALL SELECT item_id, 1, 'src' || item_id % 23, {_WS.format('text')} FROM benchmark),
    m AS (SELECT qid, member, accession, needle, cd.* FROM tr JOIN cd ON contains(norm, needle)),
    g AS (SELECT qid, member, count(*) AS n, list(r ORDER BY r) AS rows, list_sort(list(DISTINCT section)) AS sections, max(dup) AS dup, count(DISTINCT a) AS acc, count(DISTINCT norm) AS texts
          FROM m WHERE accession = 'ANY' OR a = accession GROUP BY ALL),
    sp AS (SELECT qid, count(*) AS cc, count(DISTINCT a) AS ca FROM m WHERE member = 0 GROUP BY ALL)"""


@query(rf"""WITH {_RESOLVE} SELECT qid, member, coalesce(n, 0) AS match_count,
    CASE WHEN n > 0 AND accession = 'ANY' THEN 'dedup_measured' WHEN n > 3 THEN 'too_generic' WHEN n > 0 THEN 'ok' WHEN accession = 'ANY' THEN 'quote_absent'
         WHEN accession NOT IN (SELECT source FROM documents) THEN 'accession_not_indexed' ELSE 'quote_absent' END AS status,
    array_to_string(rows, ',') AS rows, array_to_string(sections, ',') AS sections, dup AS duplicate_text_count FROM tr LEFT JOIN g USING (qid, member)""")
def quote_resolution(spark, d):
    rows = resolve.resolve(_truths(spark, d), resolve.normalised(_chunks(spark, d)))
    return rows.select("qid", "member", "match_count", "status", F.array_join(F.transform("rows", lambda r: r.cast("string")), ",").alias("rows"), F.array_join("sections", ",").alias("sections"), "duplicate_text_count")


@query(rf"WITH {_RESOLVE} SELECT qid, cc AS corpus_chunks, ca AS corpus_accessions, acc AS distinct_accessions, texts AS distinct_texts FROM sp JOIN g USING (qid) WHERE member = 0")
def quote_spread(spark, d):
    rows = resolve.resolve(_truths(spark, d).filter("member = 0"), resolve.normalised(_chunks(spark, d))).filter("match_count > 0")
    return rows.select("qid", "corpus_chunks", "corpus_accessions", "distinct_accessions", "distinct_texts")


@query("""WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
    SELECT sum(n)::BIGINT AS total, count(*) AS distinct_texts, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS in_groups, (coalesce(sum(n) FILTER (n > 1), 0) - count(*) FILTER (n > 1))::BIGINT AS redundant FROM g""")
def exact_dup_census(spark, d):
    return audit.duplicate_census(_chunks(spark, d))["totals"]


@query("""WITH w AS (SELECT lang, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT lang || '/primary' AS grp, count(*) AS n FROM w WHERE n > 1 GROUP BY ALL""")
def dup_by_form(spark, d):
    return audit.duplicate_census(_chunks(spark, d))["by_form"]


@query("SELECT n, chars FROM (SELECT count(*) AS n, length(text) AS chars, sha256(text) AS h FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, h LIMIT 5)")
def dup_largest(spark, d):
    return audit.duplicate_census(_chunks(spark, d))["largest"].select("n", "chars")


def _hits(spark, d):
    return fusion.hits(_bm25(spark, d), _chunks(spark, d))


@query(f"""WITH {_BM25} SELECT qid, count(*) AS hits, count(DISTINCT source) AS distinct_accessions, count(DISTINCT text) AS distinct_texts,
    round(count(DISTINCT source) / count(DISTINCT text), 2) AS ratio FROM bm JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY qid""")
def dedup_over_hits(spark, d):
    return score.dedup_over_hits(_hits(spark, d)).drop("tickers")


def _resolutions(spark, d):
    return resolve.resolve(_truths(spark, d).filter("member = 0"), resolve.normalised(_chunks(spark, d))).filter("match_count > 0")


_RANKS = rf"""WITH {_BM25}, {_RESOLVE}, hit AS (SELECT qid, doc_id, rank FROM bm WHERE rank <= 20),
    fr AS (SELECT g.qid, min(rank) AS rank, any_value(len(g.rows)) AS k FROM g LEFT JOIN hit ON hit.qid = g.qid AND list_contains(g.rows, hit.doc_id) WHERE g.member = 0 GROUP BY g.qid)"""


@query(f"""{_RANKS} SELECT qid, rank, coalesce(rank <= 5, false) AS recall_at_5, coalesce(rank <= 20, false) AS recall_at_20, coalesce(rank = 1, false) AS top1_correct, k AS target_chunks FROM fr""")
def recall_at_k(spark, d):
    return score.single_fact(_hits(spark, d), _resolutions(spark, d)).drop("citation_correct")


@query(f"""{_RANKS} SELECT 'single_fact' AS type, count(*) AS n, round(avg((coalesce(rank <= 5, false))::INT), 4) AS recall_at_5, round(avg((coalesce(rank <= 20, false))::INT), 4) AS recall_at_20 FROM fr""")
def recall_by_type(spark, d):
    rows = score.single_fact(_hits(spark, d), _resolutions(spark, d)).select(F.lit("single_fact").alias("type"), "recall_at_5", "recall_at_20")
    return score.recall_by_type(rows)


def _sources(spark, d):
    """Members of a question: the sources that hold its passage."""
    return resolve.holders(_truths(spark, d).filter("member = 0"), resolve.normalised(_chunks(spark, d))).select("qid", F.col("accession").alias("member"), "accession")


@query(rf"""WITH {_BM25}, {_RESOLVE}, hit AS (SELECT qid, source, rank FROM bm JOIN documents USING (doc_id) WHERE rank <= 20),
    s AS (SELECT qid, list_sort(list(DISTINCT a)) AS l FROM m WHERE member = 0 GROUP BY qid),
    mm AS (SELECT qid, unnest(l) AS source FROM s), r AS (SELECT mm.qid, mm.source, min(rank) AS rank FROM mm LEFT JOIN hit USING (qid, source) GROUP BY ALL)
    SELECT qid, bool_and(coalesce(rank <= 5, false)) AS recall_at_5, count(*) FILTER (rank <= 5) AS covered_at_5, bool_and(coalesce(rank <= 20, false)) AS recall_at_20,
           count(*) FILTER (rank <= 20) AS covered_at_20, count(*) AS members_total FROM r GROUP BY qid""")
def coverage_at_k(spark, d):
    return score.coverage(_hits(spark, d), _sources(spark, d), True)


_FIRST = rf"""WITH {_BM25}, {_RESOLVE}, x AS (SELECT bm.score AS s, bm.qid IN (SELECT qid FROM g WHERE member = 0) AS a FROM bm WHERE rank = 1)"""


def _first_scores(spark, d):
    known = _resolutions(spark, d).select(F.col("qid").alias("q"))
    rows = _bm25(spark, d, 1).join(known, F.col("qid") == F.col("q"), "left")
    return rows.select("score", F.when(F.col("q").isNull(), "negative").otherwise("answerable").alias("kind"))


@query(f"""{_FIRST} SELECT round(median(s) FILTER (a), 4) AS answerable_median, round(median(s) FILTER (NOT a), 4) AS negative_median,
    round(round(median(s) FILTER (a), 4) - round(median(s) FILTER (NOT a), 4), 4) AS median_separation, round(min(s) FILTER (a), 4) AS lowest_answerable,
    round(max(s) FILTER (NOT a), 4) AS highest_negative, coalesce(min(s) FILTER (a) <= max(s) FILTER (NOT a), false) AS distributions_overlap FROM x""")
def headline_separation(spark, d):
    return score.headline(_first_scores(spark, d))


@query(f"""{_FIRST} SELECT CASE WHEN a THEN 'answerable' ELSE 'negative' END AS kind, count(*) AS n, round(min(s), 4) AS min, round(median(s), 4) AS median, round(max(s), 4) AS max FROM x GROUP BY a""")
def score_stats(spark, d):
    return score.score_stats(_first_scores(spark, d)).drop("scores")


@query("""WITH r AS (SELECT lang || '/primary' AS grp, CASE WHEN doc_id % 3 > 0 THEN 's' || doc_id % 3 ELSE '(unsectioned)' END AS section, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL)
    SELECT *, CASE WHEN sum(chars) OVER (PARTITION BY grp) > 0 THEN round(100.0::DOUBLE * chars / sum(chars) OVER (PARTITION BY grp), 2) ELSE 0.0::DOUBLE END AS pct FROM r""")
def section_distribution(spark, d):
    return ck.section_distribution(_chunks(spark, d))


@query("""SELECT lang || '/primary' AS grp, count(*) AS count, min(length(text)) AS body_min, trunc(median(length(text)))::INT AS body_median, max(length(text)) AS body_max,
    count(*) FILTER (length(text) < 500) AS under_short_text, sum(length(text))::BIGINT AS total_body_chars FROM documents GROUP BY lang""")
def corpus_profile(spark, d):
    rows = _t(spark, d, "documents").select(F.col("lang").alias("form"), F.lit("primary").alias("doc_type"), F.length("text").alias("body_chars"), F.lit(0).alias("item_chars"))
    return audit.by_form(rows, 500, 500).drop("item_anchor_matched", "item_min", "item_median", "item_max", "under_short_item")


@query("""SELECT source AS ticker, count(*) AS documents, count(*) FILTER (doc_id % 2 = 0) AS "primary", count(*) FILTER (doc_id % 2 = 1) AS exhibit, min(length(text)) AS body_min,
    trunc(median(length(text)))::INT AS body_median, max(length(text)) AS body_max, count(*) FILTER (doc_id % 5 = 0) AS unresolved_exhibit_refs FROM documents GROUP BY source""")
def corpus_by_ticker(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "primary").otherwise("exhibit")
    open_ = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("99"))).otherwise(F.array().cast("array<string>"))
    return audit.by_ticker(_t(spark, d, "documents").select(F.col("source").alias("ticker"), kind.alias("doc_type"), F.length("text").alias("body_chars"), open_.alias("exhibits_unresolved")))


@query("""SELECT ticker, accession FROM (SELECT source AS ticker, doc_id::VARCHAR AS accession, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id::VARCHAR) AS p FROM documents) WHERE p <= 3""")
def seeded_sample(spark, d):
    return audit.sample(_t(spark, d, "documents").select(F.col("source").alias("ticker"), F.col("doc_id").cast("string").alias("accession")), 3, 7)


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))""")
def incremental_antijoin(spark, d):
    done = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledgers.outstanding(_t(spark, d, "orders").select("o_orderkey"), done, ("o_orderkey",))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    rows = _t(spark, d, "events").withColumn("seq", F.struct("ts", "event_id"))
    return ledgers.latest(rows, ("user_id",)).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND o_orderstatus IN ('O', 'P')")
def date_window_filter(spark, d):
    rows = _t(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P"))
    return rows.filter(dc.in_window(F.date_format("o_orderdate", "yyyy-MM-dd"), "1995-01-01", "1996-06-30")).select("o_orderkey")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def keep_first_dedup(spark, d):
    return ledgers.keep_first(_t(spark, d, "events"), ("user_id", "event_type"), "event_id").select("event_id", "user_id", "event_type")


@query("SELECT user_id::VARCHAR || '/' || event_type AS key, count(*) - 1 AS extra FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return ledgers.duplicates(_t(spark, d, "events"), ("user_id", "event_type")).select(F.concat_ws("/", "key.user_id", "key.event_type").alias("key"), "extra")


@query("""SELECT accession, row_number() OVER (ORDER BY ticker, filing_date DESC, accession, CASE WHEN doc_type = 'primary' THEN 0 ELSE 1 END, document) AS place FROM
    (SELECT o_orderpriority AS ticker, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, o_orderkey::VARCHAR AS accession, CASE WHEN o_orderkey % 2 = 0 THEN 'primary' ELSE 'exhibit' END AS doc_type, 'd' AS document FROM orders)""")
def manifest_order(spark, d):
    rows = _t(spark, d, "orders").select(
        F.col("o_orderpriority").alias("ticker"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"), F.col("o_orderkey").cast("string").alias("accession"),
        F.when(F.col("o_orderkey") % 2 == 0, "primary").otherwise("exhibit").alias("doc_type"), F.lit("d").alias("document"),
    )
    return dc.placed(rows).select("accession", "place")


@query("""SELECT n_regionkey AS region, i AS seq, names[i + 1] AS name, keys[i + 1] AS nationkey FROM
    (SELECT *, unnest(range(least(len(names), len(keys)))) AS i FROM (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names, list(n_nationkey ORDER BY n_nationkey)[:3] AS keys FROM nation GROUP BY n_regionkey))""")
def columnar_unpivot(spark, d):
    both = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    blocks = _t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(both.alias("b"))
    blocks = blocks.select("region", F.transform("b", lambda x: x["n_name"]).alias("name"), F.slice(F.transform("b", lambda x: x["n_nationkey"]), 1, 3).alias("nationkey"))
    return dc.unpivot(blocks, ["name", "nationkey"])


@query("""WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN true ELSE a <= DATE '1994-12-31' AND b >= DATE '1994-01-01' END AS overlaps FROM s""")
def shard_overlap(spark, d):
    s = _t(spark, d, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("b"))
    start = F.when(F.col("o_custkey") % 7 == 0, "unknown").otherwise(F.col("a"))
    return s.select("o_custkey", dc.shard_overlaps(start, F.col("b"), "1994-01-01", "1994-12-31").alias("overlaps"))


@query("""SELECT o_orderkey, lpad(o_custkey::VARCHAR, 10, '0') AS cik, lpad(o_orderkey::VARCHAR, 10, '0') || '-96-000001' AS accession,
    'https://archive.example/Archives/edgar/data/' || o_custkey || '/' || lpad(o_orderkey::VARCHAR, 10, '0') || '96000001/doc.htm' AS url,
    lpad(o_orderkey::VARCHAR, 10, '0') || '96000001-doc_1.html' AS stored FROM orders""")
def identifier_forms(spark, d):
    bare = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("96000001"))
    cik = F.concat(F.lit(" cik"), F.col("o_custkey").cast("string"))
    o = _t(spark, d, "orders").select("o_orderkey", bare.alias("a"), cik.alias("c"))
    return o.select(
        "o_orderkey", tx.cik10(F.col("c")).alias("cik"), tx.accession_dashed(F.col("a")).alias("accession"), tx.document_url(ARCHIVE, F.col("c"), F.col("a"), F.lit("/doc.htm")).alias("url"),
        tx.stored_name(F.col("a"), F.lit("exhibit"), F.lit("up\\..\\doc 1.htm"), F.lit(".html")).alias("stored"),
    )


@query("""WITH p AS (SELECT ps.s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '99' WHEN s_suppkey % 3 = 1 THEN '99.1' ELSE '10.' || s_suppkey % 4 END AS label, CASE WHEN s_suppkey % 2 = 0 THEN ['99.1', '10.1'] ELSE ['99.2'] END AS present FROM supplier ps)
    SELECT id, label, list_contains(present, label) OR (NOT contains(label, '.') AND len([x FOR x IN present IF starts_with(x, label || '.')]) > 0) AS resolved FROM p""")
def exhibit_labels(spark, d):
    k = F.col("s_suppkey")
    label = F.when(k % 3 == 0, "99").when(k % 3 == 1, "99.1").otherwise(F.concat(F.lit("10."), (k % 4).cast("string")))
    present = F.when(k % 2 == 0, F.array(F.lit("99.1"), F.lit("10.1"))).otherwise(F.array(F.lit("99.2")))
    rows = _t(spark, d, "supplier").select(k.alias("id"), label.alias("label"), present.alias("present"))
    return rows.select("id", "label", tx.label_present(F.col("label"), F.col("present")).alias("resolved"))


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def universe_match(spark, d):
    known = _t(spark, d, "nation").select(F.upper("n_name").alias("ticker"), F.col("n_nationkey").cast("string").alias("cik"), F.col("n_name").alias("company_name"))
    matched = dc.match_universe(known.select("ticker"), known)
    c = _t(spark, d, "customer").withColumn("cik", F.lpad(F.col("c_nationkey").cast("string"), 10, "0"))
    return c.join(matched, "cik").select("c_custkey", F.col("company_name").alias("n_name"))


@query("""SELECT vec_id, abs(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) <= 0.002 AS unit FROM embeddings""")
def unit_vectors(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", tx.is_unit(F.col("embedding")).alias("unit"))


@query("""SELECT conv_id, turn, text FROM (SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM conversations WHERE role = 'user') WHERE text <> '' AND NOT starts_with(text, '#')""")
def question_scan(spark, d):
    rows = _t(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", tx.strip(F.col("text")).alias("text"))
    return rows.filter((F.col("text") != "") & ~F.col("text").startswith("#"))


@query("""WITH m AS (SELECT unnest(regexp_extract_all(text, '([Tt]he) (.{0,12})', 0)) AS m FROM documents),
    g AS (SELECT upper(m[1:3]) AS item, trim(regexp_replace(m[5:], '[\\s\\x1c-\\x1f]+', ' ', 'g'))[1:8] AS tail, count(*) AS n FROM m GROUP BY ALL)
    SELECT item, tail, n, place FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, tail) AS place FROM g) WHERE place <= 6""")
def heading_census(spark, d):
    return ck.heading_census(_t(spark, d, "documents"), "([Tt]he) (.{0,12})", 8, 6)


@query("SELECT doc_id, lang, length(text) AS n FROM documents WHERE length(text) <= 2000")
def overlong_refused(spark, d):
    kept, _ = ck.split_overlong(_t(spark, d, "documents").withColumn("n_tokens", F.length("text")), 2000)
    return kept.select("doc_id", "lang", F.col("n_tokens").alias("n"))


@query()
def html_text(spark, d):
    return _t(spark, d, "pages").select("page_id", visible(F.col("html")).alias("text"))


def _anchored(spark, d):
    return _t(spark, d, "documents").select(
        F.lit("1").alias("cik"), F.col("source").alias("ticker"), F.concat(F.lit("a"), "doc_id").alias("accession"), F.col("lang").alias("form"), F.lit(None).cast("string").alias("filing_date"),
        F.lit(None).cast("string").alias("period_of_report"), F.when(F.col("doc_id") % 5 == 0, "exhibit").otherwise("primary").alias("doc_type"), F.lit("d.htm").alias("document"), F.lit("EX-99.1").alias("exhibit_label"), "text",
    )


@query()
def section_spans(spark, d):
    t = _anchored(spark, d)
    t = w.with_spans(t, ANCHORS, 60, flags=0)
    return t.select("accession", F.posexplode("spans").alias("nth", "s")).select("accession", "nth", "s.label", "s.start", "s.end")


@query()
def snapped_windows(spark, d):
    made = w.cut_windows(F.col("text"), w.CharWindows(500, 100))
    return _t(spark, d, "documents").select("doc_id", F.posexplode(made).alias("nth", "x")).select("doc_id", "nth", "x.start", "x.end")


@query()
def token_windows(spark, d):
    made = w.cut_windows(F.col("text"), w.TokenWindows(120, 24))
    return _t(spark, d, "documents").select("doc_id", F.posexplode(made).alias("nth", "x")).select("doc_id", "nth", "x.start", "x.end", "x.n")


@query()
def document_chunks(spark, d):
    return ck.chunk(_anchored(spark, d), w.CharWindows(450, 90), ANCHORS, 60, flags=0).select("chunk_id", "section", "chunk_ordinal", "n_tokens", "char_span.start", "char_span.end", "text")


@query()
def anchor_trial(spark, d):
    t = w.with_spans(_anchored(spark, d), ANCHORS, 60, flags=0)
    return ck.anchor_trial(t.select("ticker", "accession", "spans"), "the")


@query()
def hashed_dense_top5(spark, d):
    vectors = embed(_docs(spark, d), "hashing", {"dim": 64}).select("row", "embedding")
    asked = embed(_questions(spark, d), "hashing", {"dim": 64}).select("qid", "embedding")
    return dense.search(vectors, asked, 5).select("qid", "rank", F.col("row").alias("doc_id"), F.round("score", 5).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_known)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
