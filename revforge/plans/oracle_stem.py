"""Oracle SQL (DuckDB) for the stem queries: the extended Porter algorithm as one table expression a step.

The rules are written out here, so that the SQL shares nothing with the code it checks. Every step keeps the word ``w``
and its mask ``m`` (``c`` consonant, ``v`` vowel); a measure counts ``vc`` in the mask of a stem.
"""

from __future__ import annotations

from .oracle_prep import RAW
from .oracle_text import TOKEN_ROWS, TOKS

MASK = """list_reduce(list_prepend('', string_split(regexp_replace(regexp_replace(w, '[^aeiouy]', 'c', 'gs'), '[aeiou]', 'v', 'g'), '')),
  lambda d, x: d || CASE WHEN x <> 'y' THEN x WHEN suffix(d, 'c') THEN 'v' ELSE 'c' END)"""


def _stem(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _m(n: int) -> str:
    """Measure without the last n characters."""
    cut = f"left(m, length(m) - {n})"
    return f"((length({cut}) - length(replace({cut}, 'vc', ''))) // 2)"


def _short(n: int) -> str:
    cut = f"left(m, length(m) - {n})"
    return f"((suffix({cut}, 'cvc') AND right({_stem(n)}, 1) NOT IN ('w', 'x', 'y')) OR {cut} = 'vc')"


DOUBLE = "(length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND suffix(m, 'c'))"


def _first(rules: str, least: int) -> str:
    """CASE over 'suffix>new' pairs: the first suffix that ends the word decides."""
    out = "CASE"
    for rule in rules.split():
        suf, new = rule.split(">")
        extra = " AND right(" + _stem(3) + ", 1) IN ('s', 't')" if suf == "ion" else ""
        out += f"\n WHEN suffix(w, '{suf}') THEN CASE WHEN {_m(len(suf))} > {least}{extra} THEN {_stem(len(suf))} || '{new}' ELSE w END"
    return out + "\n ELSE w END"


STEPS = [
    # 1a: plurals
    f"""CASE WHEN suffix(w, 'sses') THEN {_stem(2)} WHEN suffix(w, 'ies') THEN CASE WHEN length(w) = 4 THEN {_stem(1)} ELSE {_stem(2)} END
        WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN {_stem(1)} ELSE w END""",
    # 1b: past forms; a cut ending leaves a mark for the next step
    f"""CASE WHEN suffix(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_stem(1)} ELSE {_stem(2)} END
        WHEN suffix(w, 'eed') THEN CASE WHEN {_m(3)} > 0 THEN {_stem(1)} ELSE w END
        WHEN suffix(w, 'ed') AND contains(left(m, length(m) - 2), 'v') THEN {_stem(2)} || chr(1)
        WHEN suffix(w, 'ing') AND contains(left(m, length(m) - 3), 'v') THEN {_stem(3)} || chr(1) ELSE w END""",
    f"""CASE WHEN NOT marked THEN w WHEN suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz') THEN w || 'e'
        WHEN {DOUBLE} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {_stem(1)} WHEN {_m(0)} = 1 AND {_short(0)} THEN w || 'e' ELSE w END""",
    # 1c
    f"CASE WHEN suffix(w, 'y') AND length(w) > 2 AND suffix(left(m, length(m) - 1), 'c') THEN {_stem(1)} || 'i' ELSE w END",
    # 2
    f"CASE WHEN suffix(w, 'alli') AND {_m(4)} > 0 THEN {_stem(2)} ELSE w END",
    f"CASE WHEN suffix(w, 'logi') THEN CASE WHEN {_m(3)} > 0 THEN {_stem(1)} ELSE w END ELSE " + _first(
        "ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al fulli>ful entli>ent eli>e ousli>ous ization>ize ation>ate "
        "ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble", 0) + " END",
    # 3
    _first("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>", 0),
    # 4
    _first("al> ance> ence> er> ic> able> ible> ant> ement> ment> ent> ion> ou> ism> ate> iti> ous> ive> ize>", 1),
    # 5
    f"CASE WHEN suffix(w, 'e') AND ({_m(1)} > 1 OR ({_m(1)} = 1 AND NOT {_short(1)})) THEN {_stem(1)} ELSE w END",
    f"CASE WHEN {_m(0)} > 1 AND {DOUBLE} AND suffix(w, 'l') THEN {_stem(1)} ELSE w END",
]


def stem_chain(with_terms: bool = True) -> str:
    """Table expressions from ``terms`` (of ``trows``) to ``stems(term, stem)``."""
    out = ["terms AS MATERIALIZED (SELECT DISTINCT term FROM trows)"] * with_terms + [
           f"s0 AS MATERIALIZED (SELECT w, {MASK} AS m, false AS marked FROM (SELECT DISTINCT lower(term) AS w FROM terms) WHERE length(w) > 2)",
           "k0 AS (SELECT w AS word, w, m, marked FROM s0)"]
    for i, rule in enumerate(STEPS, 1):
        out.append(f"t{i} AS MATERIALIZED (SELECT word, {rule} AS x FROM k{i - 1})")
        out.append(f"k{i} AS MATERIALIZED (SELECT word, w, marked, {MASK} AS m FROM (SELECT word, rtrim(x, chr(1)) AS w, suffix(x, chr(1)) AS marked FROM t{i}))")
    out.append(f"""stems AS MATERIALIZED (SELECT t.term, CASE lower(t.term)
  WHEN 'sky' THEN 'sky' WHEN 'skies' THEN 'sky' WHEN 'dying' THEN 'die' WHEN 'lying' THEN 'lie' WHEN 'tying' THEN 'tie' WHEN 'news' THEN 'news'
  WHEN 'innings' THEN 'inning' WHEN 'inning' THEN 'inning' WHEN 'outings' THEN 'outing' WHEN 'outing' THEN 'outing' WHEN 'cannings' THEN 'canning'
  WHEN 'canning' THEN 'canning' WHEN 'howe' THEN 'howe' WHEN 'proceed' THEN 'proceed' WHEN 'exceed' THEN 'exceed' WHEN 'succeed' THEN 'succeed'
  ELSE coalesce(k.w, lower(t.term)) END AS stem FROM terms t LEFT JOIN k{len(STEPS)} k ON k.word = lower(t.term))""")
    return ",\n".join(out)


SQL = {
    "stem_vocab": f"WITH {RAW}, {TOKS}, {TOKEN_ROWS},\n{stem_chain()}\nSELECT term, stem FROM stems",
    "stem_text": f"""WITH {RAW}, {TOKS}, {TOKEN_ROWS},
{stem_chain()}
SELECT r.row_id, count(*) AS n_tokens, md5(string_agg(s.stem, ' ' ORDER BY r.pos)) AS stem_md5
FROM trows r JOIN stems s ON r.term = s.term GROUP BY r.row_id""",
}
