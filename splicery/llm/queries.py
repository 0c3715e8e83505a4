"""The registered queries of this subpackage and their SQL: thin wrappers that shape an operator's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splicery.llm.toxicity import toxicity

    out = toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splicery.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splicery.llm.html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from splicery.llm.pieces import encode_pieces

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return out.select("doc_id", "n_pieces", "ids_crc32", "best_score", "n_best", "last_score", "round_trip")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splicery.llm.license_scan import scan_licenses

    out = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splicery.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from splicery.llm.token_output import token_files

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splicery.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splicery.llm.mixing import in_training_order, mix

    out = mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return in_training_order(out.select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splicery.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_extract": op3_html_extract,
    "op4_pieces": op4_pieces,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprint": op6_fingerprint,
    "op7_token_output": op7_token_output,
    "op8_near_dedup": op8_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, (f.k IS NOT NULL AND l.doc_id <> f.keeper) AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
), label AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM label LEFT JOIN n USING (doc_id)
""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.25 ELSE 0.75 END)::DOUBLE AS slope,
         (sum(source_size) OVER ())::BIGINT AS all_words FROM s
), l AS (
  SELECT *, (all_words - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev,
         row_number() OVER o AS rk
  FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST)
), v AS (
  SELECT *, (SELECT arg_min(lev, rk) FROM l WHERE lev * weight <= 3 * source_size) AS water FROM l
), t AS (
  SELECT source, source_size, slope, coalesce(least(3.0::DOUBLE * source_size, water * weight), 0.0::DOUBLE) AS target FROM v
), p AS (
  SELECT d.*, t.source_size, t.target, t.slope,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT p.*, k, greatest(0, least(size, floor(target + 0.5)::BIGINT - c - k * source_size)) AS words, (k * source_size + c) / target AS done
  FROM p CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)
), x AS (
  SELECT *, 2 * done / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * done)) AS position FROM u WHERE words > 0
), y AS (
  SELECT doc_id, source, c, sum(words) AS taken, arg_min(position, k) AS first_position, arg_max(position, k) AS last_position FROM x GROUP BY ALL
)
SELECT p.doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_position, last_position
FROM p LEFT JOIN y ON y.doc_id IS NOT DISTINCT FROM p.doc_id AND y.source IS NOT DISTINCT FROM p.source AND y.c = p.c AND p.size > 0
""",
    "op10_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
""",
}
