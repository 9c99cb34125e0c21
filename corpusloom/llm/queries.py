"""The operators' queries over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, exact_dedup, fingerprints, mixing, ngram_join, packing, quality, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public byte-level BPE; a parameter of the packing operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.chunk_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [
        op1_warc_bundles, op2_quality, op3_suffix_dedup, op4_best_fit_packing, op5_toxicity,
        op6_chunk_dedup, op7_mix_sources, op8_exact_dedup, op9_near_duplicates, op10_fingerprints,
    ]
    return {f.__name__: f for f in names}


def _print_sql(text: str) -> str:
    """A fingerprint in SQL."""
    leaves = f"[sha256(x) FOR x IN regexp_extract_all({text}, '[^\\n]{{1,40}}\\n?|\\n')]"
    return (
        f"(SELECT sha256(array_to_string(s, '')) || ':' || array_to_string([x[1:8] FOR x IN s], '') || ':' || array_to_string([x[1:8] FOR x IN l], '') FROM "
        f"(SELECT l, [sha256(array_to_string(l[i * 8 + 1 : i * 8 + 8], '')) FOR i IN range((len(l) + 7) // 8)] AS s FROM (SELECT {leaves} AS l)))"
    )


def _likeness_sql(a: str, b: str) -> str:
    part = "list_distinct(regexp_extract_all(split_part({}, ':', 3), '.{{8}}'))"
    x, y = part.format(a), part.format(b)
    return f"CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / greatest(len({x}) + len({y}), 1) END"


def oracle_sql() -> dict[str, str]:
    return {
        "op9_near_duplicates": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
            n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r(id, hit) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.hit = e.a)
            SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(hit) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id""",
        "op10_fingerprints": f"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            x AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u FROM d),
            y AS (SELECT doc_id, n, t, u, substring(t, 1, n - n // 4) || substring(u, 1, n // 4) AS e FROM x),
            z AS (SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, {_print_sql("t")} AS fingerprint, {_print_sql("e")} AS edited_fingerprint, {_print_sql("u")} AS next_fingerprint FROM y)
            SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_likeness_sql("fingerprint", "edited_fingerprint")} AS near_edited,
                   {_likeness_sql("fingerprint", "next_fingerprint")} AS near_next FROM z""",
        "op1_warc_bundles": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
            SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM q""",
        "op8_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
            w AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                         row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS rn FROM n)
            SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM w""",
        "op7_mix_sources": r"""
            WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                 -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0)
                 / greatest(0.05, coalesce(1 - 4.0::DOUBLE * (length(text) - length(translate(text, '%*#$&|!', ''))) / nullif(length(text), 0), 1.0))::DOUBLE AS k
                 FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
            p AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
                         2.0::DOUBLE * source_size AS cap FROM s),
            q AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS l,
                         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS op
                  FROM p WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            g AS (SELECT *, CASE WHEN cap * op <= w * l THEN cap ELSE w * max(l / op) FILTER (WHERE NOT cap * op <= w * l) OVER () END::DOUBLE AS target FROM q),
            e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM g),
            b AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
                         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
                  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
            SELECT doc_id, size, source_size, target,
                   (size * (epochs + CASE WHEN budget > 0 AND before + size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM b""",
    }
