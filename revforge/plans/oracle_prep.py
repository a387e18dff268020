"""Oracle SQL (DuckDB dialect) for the preparation queries. Written independently of the Spark
plans: same semantics, expressed as plain SQL over the driver tables."""

from __future__ import annotations


def _rep(c: str) -> str:
    return (f"CASE {c} WHEN 'PD' THEN 'bug report' WHEN 'RT' THEN 'rating' "
            f"WHEN 'UE' THEN 'user experience' WHEN 'FR' THEN 'feature request' ELSE {c} END")


RAW = """raw AS (
  SELECT CAST(doc_id AS BIGINT) AS row_id, text AS review,
         CASE lang WHEN 'en' THEN 'PD' WHEN 'de' THEN 'FR' WHEN 'es' THEN 'RT' WHEN 'fr' THEN 'UE'
                   ELSE lang END AS label,
         source AS package
  FROM documents)"""

RECODED = f"""recoded AS (
  SELECT row_id, {_rep('review')} AS review, {_rep('label')} AS label, {_rep('package')} AS package
  FROM raw)"""

CODED = """coded AS (
  SELECT *, CASE label WHEN 'bug report' THEN 0 WHEN 'feature request' THEN 1 WHEN 'rating' THEN 2
                       ELSE 3 END AS new_label
  FROM recoded)"""

BASE = f"WITH {RAW},\n{RECODED},\n{CODED}"

MULTI = """multi AS (
  SELECT CAST(d.doc_id AS BIGINT) AS row_id, d.text AS review,
         CAST(l.quality AS BIGINT) AS bug_report, CAST(l.toxic AS BIGINT) AS user_experience,
         CAST(d.lang = 'en' AS BIGINT) AS rating, CAST(d.n_chars > 1000 AS BIGINT) AS feature_request
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

PAIRS = """pairs AS (
  SELECT CAST(d.doc_id AS BIGINT) AS row_id, d.text AS review,
         CASE WHEN l.quality = 0 AND l.toxic = 0 THEN 'bug report'
              WHEN l.quality = 0 AND l.toxic = 1 THEN 'feature request'
              WHEN l.quality = 1 AND l.toxic = 0 THEN 'rating'
              WHEN l.quality = 1 AND l.toxic = 1 THEN 'user experience' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _balance(desc: bool, quota: str) -> str:
    order = "length(review) DESC NULLS LAST, row_id" if desc else "length(review) ASC NULLS LAST, row_id"
    return f"""{BASE}
SELECT row_id, CAST(new_label AS BIGINT) AS new_label, CAST(length(review) AS BIGINT) AS review_len,
       CAST(class_rank AS BIGINT) AS class_rank
FROM (SELECT *, row_number() OVER (PARTITION BY new_label ORDER BY {order}) AS class_rank FROM coded) q
JOIN (VALUES {quota}) quota(qlabel, k) ON q.new_label = quota.qlabel
WHERE class_rank <= k"""


SQL = {
    "balance_longest": _balance(True, "(0, 50), (1, 50), (2, 200), (3, 50)"),
    "balance_shortest": _balance(False, "(0, 100), (1, 100), (2, 100), (3, 100)"),
    "class_counts": f"""{BASE}
SELECT CAST(c.code AS BIGINT) AS new_label, CAST(c.pos AS BIGINT) AS print_pos,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n
FROM (VALUES (0, 0), (1, 2), (2, 1), (3, 3)) c(code, pos)
LEFT JOIN (SELECT new_label, count(*) AS n FROM coded GROUP BY new_label) n ON n.new_label = c.code""",
    "filter_present": f"""WITH {RAW}
SELECT row_id, label, CAST(length(review) AS BIGINT) AS review_len FROM raw
WHERE review IS NOT NULL AND review <> ''""",
    "filter_class": f"""{BASE}
SELECT row_id, CAST(new_label AS BIGINT) AS new_label, package FROM coded WHERE new_label = 2""",
    "project_reviews": f"""{BASE}
SELECT row_id, label, CAST(new_label AS BIGINT) AS new_label FROM coded""",
    "recode_labels": f"""{BASE}
SELECT row_id, label, package FROM recoded""",
    "label_code": f"""{BASE}
SELECT label, CAST(new_label AS BIGINT) AS new_label, count(*) AS n FROM coded GROUP BY label, new_label""",
    "clean_text": f"""WITH {RAW}
SELECT row_id, CAST(length(regexp_replace(review, '[^\\x20-\\x7E]', '', 'g')) AS BIGINT) AS clean_len,
       md5(regexp_replace(review, '[^\\x20-\\x7E]', '', 'g')) AS clean_md5
FROM raw WHERE review IS NOT NULL AND review <> ''""",
    "text_length_stats": f"""{BASE}
SELECT CAST(new_label AS BIGINT) AS new_label, count(*) AS n,
       CAST(min(length(review)) AS BIGINT) AS min_len, CAST(max(length(review)) AS BIGINT) AS max_len,
       CAST(sum(length(review)) AS BIGINT) AS sum_len,
       CAST(sum(length(regexp_replace(review, '[^\\x20-\\x7E]', '', 'g'))) AS BIGINT) AS sum_clean_len
FROM coded GROUP BY new_label""",
    "rename_cols": f"""{BASE}
SELECT row_id, package AS "ID", CAST(new_label AS BIGINT) AS new_label FROM coded""",
    "drop_cols": f"""{BASE}
SELECT row_id, label, package, CAST(new_label AS BIGINT) AS new_label FROM coded""",
    "add_row_ids": f"""{BASE}
SELECT row_number() OVER (ORDER BY new_label, class_rank) AS "ID", row_id,
       CAST(new_label AS BIGINT) AS new_label
FROM (SELECT row_id, new_label,
             row_number() OVER (PARTITION BY new_label ORDER BY length(review) DESC NULLS LAST, row_id)
               AS class_rank
      FROM coded) q
JOIN (VALUES (0, 50), (1, 50), (2, 200), (3, 50)) quota(qlabel, k) ON q.new_label = quota.qlabel
WHERE class_rank <= k""",
    "pack_flags": f"""WITH {MULTI}
SELECT row_id, CAST(p AS BIGINT) AS flag_pos, CAST(v AS DOUBLE) AS flag_value FROM (
  SELECT row_id, 0 AS p, bug_report AS v FROM multi UNION ALL
  SELECT row_id, 1, user_experience FROM multi UNION ALL
  SELECT row_id, 2, rating FROM multi UNION ALL
  SELECT row_id, 3, feature_request FROM multi)""",
    "sort_by_length": f"""WITH {RAW}
SELECT row_id, row_number() OVER (ORDER BY length(review) DESC NULLS LAST, row_id) AS length_rank,
       CAST(length(review) AS BIGINT) AS review_len
FROM raw""",
    "top_longest": f"""WITH {MULTI}
SELECT row_id, CAST(length(review) AS BIGINT) AS review_len FROM multi
ORDER BY length(review) DESC NULLS LAST, row_id LIMIT 25""",
    "nested_cuts": f"""WITH {MULTI}
SELECT row_id, length_rank,
       CAST(CASE WHEN length_rank <= 10 THEN 10 WHEN length_rank <= 100 THEN 100
                 WHEN length_rank <= 250 THEN 250 ELSE 500 END AS BIGINT) AS cut
FROM (SELECT row_id, row_number() OVER (ORDER BY length(review) DESC NULLS LAST, row_id) AS length_rank
      FROM multi) q
WHERE length_rank <= 500""",
    "union_sources": f"""{BASE},
u AS (SELECT row_id, review, label, CAST(NULL AS BIGINT) AS turn FROM recoded
      UNION ALL SELECT NULL, text, role, CAST(turn AS BIGINT) FROM conversations)
SELECT label, count(*) AS n, count(row_id) AS n_row_id, count(turn) AS n_turn,
       CAST(sum(length(review)) AS BIGINT) AS sum_len
FROM u GROUP BY label""",
    "numeric_sums": f"""{BASE},
b AS (SELECT row_id, new_label, class_rank FROM (
        SELECT row_id, new_label,
               row_number() OVER (PARTITION BY new_label ORDER BY length(review) DESC NULLS LAST, row_id)
                 AS class_rank
        FROM coded) q
      JOIN (VALUES (0, 50), (1, 50), (2, 200), (3, 50)) quota(qlabel, k) ON q.new_label = quota.qlabel
      WHERE class_rank <= k)
SELECT 'row_id' AS "column", CAST(sum(row_id) AS DOUBLE) AS total, CAST(sum(row_id) AS VARCHAR) AS exact FROM b
UNION ALL SELECT 'new_label', CAST(sum(new_label) AS DOUBLE), CAST(sum(new_label) AS VARCHAR) FROM b
UNION ALL SELECT 'class_rank', CAST(sum(class_rank) AS DOUBLE), CAST(sum(class_rank) AS VARCHAR) FROM b
UNION ALL SELECT 'empty_flag', 0.0, '0'""",
    "label_dictionary": f"""{BASE}
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_code
FROM (SELECT DISTINCT label FROM recoded WHERE label IS NOT NULL)""",
    "preview": f"""{BASE}
SELECT row_id, label, CAST(new_label AS BIGINT) AS new_label, package FROM coded ORDER BY row_id LIMIT 5""",
    "scan_table": f"""{BASE}
SELECT row_id, label, CAST(new_label AS BIGINT) AS new_label, package FROM coded""",
    "scan_reviews": f"""WITH {RAW}
SELECT row_id, label, package, CAST(length(review) AS BIGINT) AS review_len, md5(review) AS review_md5
FROM raw""",
    "per_dataset_counts": f"""{BASE}, {PAIRS},
s AS (SELECT 'reviews' AS dataset, label FROM recoded
      UNION ALL SELECT 'conversations', role FROM conversations
      UNION ALL SELECT 'pairs', label FROM pairs)
SELECT dataset, label, count(*) AS n FROM s GROUP BY dataset, label""",
}
