"""Oracle SQL (DuckDB) for the token-level queries."""

from __future__ import annotations

from ..functions.constants import NOUN_SUFFIX_RULES, STOP_WORDS
from .oracle_prep import RAW


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# the tokenizer's rules, written out here so that the SQL does not share the code it checks
_TOKEN = (r"[\pL\pM\pN]+(?:(?:[-.'/_][\pL\pM\pN]+)|(?:[:,]\pN[\pL\pM\pN]*))*"
          r"|[.]{3}|-{2}|[^\x00-\x20\x7F-\xA0\pZ\pL\pM\pN]")


def _cut(n: int) -> str:
    return f"[left(x, length(x) - {n}), right(x, {n})]"


def tok(col: str, clean: bool = False) -> str:
    source = f"regexp_replace({col}, '[^ -~]', '', 'g')" if clean else col
    return f"""flatten(list_transform(regexp_extract_all({source}, {_lit(_TOKEN)}), lambda x: CASE
      WHEN lower(x) IN ('cannot', 'more''n') THEN [left(x, length(x) - (CASE WHEN lower(x) = 'cannot' THEN 3 ELSE 2 END)),
                                                  right(x, CASE WHEN lower(x) = 'cannot' THEN 3 ELSE 2 END)]
      WHEN lower(x) IN ('gimme', 'gonna', 'gotta', 'lemme', 'wanna') THEN {_cut(2)}
      WHEN lower(x) = 'd''ye' THEN {_cut(3)}
      WHEN regexp_full_match(x, '.+(?:[nN]''[tT]|''(?:ll|LL|lL|Ll|[rRvV][eE]))') THEN {_cut(3)}
      WHEN regexp_full_match(x, '.+''[sSmMdD]') THEN {_cut(2)}
      ELSE [x] END))"""


STOPS = "[" + ", ".join(_lit(w) for w in STOP_WORDS) + "]"

TOKS = f"""toks AS MATERIALIZED (SELECT row_id, {tok('review')} AS t FROM raw)"""
TOKEN_ROWS = """trows AS MATERIALIZED (SELECT row_id, unnest(t) AS term, unnest(generate_series(0, len(t) - 1)) AS pos
                FROM toks)"""
PRESENT_TOKS = f"""ptoks AS MATERIALIZED (SELECT row_id, {tok('review', clean=True)} AS t FROM raw WHERE review IS NOT NULL AND review <> '')"""
PRESENT_ROWS = """prows AS (SELECT row_id, unnest(t) AS term, unnest(generate_series(0, len(t) - 1)) AS pos
                 FROM ptoks)"""
BENCH_ROWS = f"""brows AS (SELECT unnest({tok('text')}) AS term FROM benchmark)"""
LEX = """lex AS MATERIALIZED (SELECT DISTINCT lower(term) AS word FROM trows UNION SELECT DISTINCT lower(term) FROM brows)"""


def _cands() -> str:
    parts = ["SELECT term, term AS cand FROM terms"]
    for suf, rep in NOUN_SUFFIX_RULES:
        n = len(suf)
        parts.append(
            f"SELECT term, left(term, length(term) - {n}) || {_lit(rep)} FROM terms "
            f"WHERE ends_with(term, {_lit(suf)}) AND length(term) - {n} + {len(rep)} > 0")
    return "cands AS (" + "\n UNION ALL ".join(parts) + ")"


LEMMA = f"""terms AS MATERIALIZED (SELECT DISTINCT term FROM trows),
{_cands()},
best AS (SELECT term, cand FROM (
           SELECT term, cand, row_number() OVER (PARTITION BY term ORDER BY length(cand), cand) AS rn
           FROM cands WHERE cand IN (SELECT word FROM lex)) WHERE rn = 1),
lemmas AS (SELECT t.term, coalesce(b.cand, t.term) AS lemma FROM terms t LEFT JOIN best b ON t.term = b.term)"""

VOCAB = """vocab AS (
  SELECT word, freq, CAST(row_number() OVER (ORDER BY freq DESC, word) - 1 + 4 AS BIGINT) AS token_id
  FROM (SELECT lower(term) AS word, count(*) AS freq FROM prows GROUP BY 1))"""

SQL = {
    "tokenize_words": f"""WITH {RAW}, {TOKS}
SELECT row_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM toks""",
    "remove_stopwords": f"""WITH {RAW}, {TOKS},
kept AS (SELECT row_id, list_filter(t, lambda x: NOT list_contains({STOPS}, lower(x))) AS k FROM toks)
SELECT row_id, CAST(len(k) AS BIGINT) AS n_kept, md5(array_to_string(k, ' ')) AS kept_md5 FROM kept""",
    "stopword_antijoin": f"""WITH {RAW}, {TOKS}, {TOKEN_ROWS}
SELECT row_id, count(*) AS n_kept FROM trows
WHERE lower(term) NOT IN (SELECT unnest({STOPS})) GROUP BY row_id""",
    "lemma_vocab": f"""WITH {RAW}, {TOKS}, {TOKEN_ROWS}, {BENCH_ROWS}, {LEX}, {LEMMA}
SELECT term, lemma FROM lemmas""",
    "lemmatize_text": f"""WITH {RAW}, {TOKS}, {TOKEN_ROWS}, {BENCH_ROWS}, {LEX}, {LEMMA}
SELECT r.row_id, count(*) AS n_tokens, md5(string_agg(l.lemma, ' ' ORDER BY r.pos)) AS lemma_md5
FROM trows r JOIN lemmas l ON r.term = l.term GROUP BY r.row_id""",
    "vocab_fit": f"""WITH {RAW}, {PRESENT_TOKS}, {PRESENT_ROWS}, {VOCAB}
SELECT word, freq, token_id FROM vocab""",
    "encode_fixed": f"""WITH {RAW}, {PRESENT_TOKS}, {PRESENT_ROWS}, {VOCAB},
ids AS (SELECT p.row_id, p.pos, coalesce(v.token_id, 1) AS token_id
        FROM prows p LEFT JOIN vocab v ON lower(p.term) = v.word WHERE p.pos < 126),
seqs AS (SELECT row_id, count(*) AS n, string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos) AS s
         FROM ids GROUP BY row_id),
docs AS (SELECT row_id FROM raw WHERE review IS NOT NULL AND review <> '')
SELECT d.row_id, CAST(128 AS BIGINT) AS n_ids, CAST(coalesce(s.n, 0) + 2 AS BIGINT) AS n_real,
       md5('2 ' || coalesce(s.s || ' ', '') || '3' || repeat(' 0', CAST(126 - coalesce(s.n, 0) AS INTEGER)))
         AS ids_md5
FROM docs d LEFT JOIN seqs s ON d.row_id = s.row_id""",
}
