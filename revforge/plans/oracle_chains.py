"""Oracle SQL (DuckDB) for the preparation chains."""

from __future__ import annotations

from .oracle_prep import CODED, RAW, RECODED
from .oracle_stem import stem_chain
from .oracle_text import BENCH_ROWS, LEMMA, LEX, TOKEN_ROWS, STOPS, tok

SQL = {
    "prepare_original": f"""WITH {RAW}, {RECODED}, {CODED},
both_ AS (SELECT 'r:' || row_id AS uid, review, label, new_label FROM coded
          UNION ALL SELECT 'c:' || conv_id || ':' || turn, text, role,
                 CASE role WHEN 'bug report' THEN 0 WHEN 'feature request' THEN 1 WHEN 'rating' THEN 2 ELSE 3 END FROM conversations)
SELECT uid, label, new_label::BIGINT AS new_label, class_rank, length(review)::BIGINT AS review_len
FROM (SELECT *, row_number() OVER (PARTITION BY new_label ORDER BY length(review) NULLS LAST, uid) AS class_rank FROM both_) WHERE class_rank <= 100""",
    "prepare_generated": f"""WITH {RAW}, {RECODED}, {CODED},
chosen AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY new_label ORDER BY length(review) DESC NULLS LAST, row_id) AS class_rank FROM coded)
  WHERE class_rank <= CASE new_label WHEN 2 THEN 200 ELSE 50 END),
toks AS MATERIALIZED (SELECT row_id, {tok('review')} AS t FROM chosen),
{TOKEN_ROWS}, {BENCH_ROWS}, {LEX}, {LEMMA},
{stem_chain(with_terms=False)},
words AS (SELECT r.row_id, string_agg(l.lemma, ' ' ORDER BY r.pos) AS lemmatization, string_agg(s.stem, ' ' ORDER BY r.pos) AS stemming
          FROM trows r JOIN lemmas l ON l.term = r.term JOIN stems s ON s.term = r.term GROUP BY r.row_id),
kept AS (SELECT row_id, array_to_string(list_filter(t, lambda x: NOT list_contains({STOPS}, lower(x))), ' ') AS no_stopwords FROM toks)
SELECT row_number() OVER (ORDER BY new_label, class_rank) AS ID, c.row_id, label, new_label::BIGINT AS new_label, md5(coalesce(review, '')) AS review_md5,
       md5(coalesce(lemmatization, '')) AS lemmatization_md5, md5(coalesce(stemming, '')) AS stemming_md5, md5(coalesce(no_stopwords, '')) AS no_stopwords_md5
FROM chosen c LEFT JOIN words w ON w.row_id = c.row_id LEFT JOIN kept k ON k.row_id = c.row_id""",
}
