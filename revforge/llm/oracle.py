"""DuckDB SQL of the queries that SQL can express, written from the contracts (nothing shared with the code)."""

from __future__ import annotations

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS v
        FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
hit AS (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(*) AS c FROM hit GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
             length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             coalesce(rep.c, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper
      FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, least(1000, n_symbols * 1000 // greatest(n_words, 1)) AS symbols,
             least(1000, n_upper * 1000 // greatest(word_chars, 1)) AS upper_,
             least(1000, n_dup_lines * 1000 // greatest(n_lines, 1)) AS dup_lines,
             least(1000, n_repeat_words * 1000 // greatest(n_words, 1)) AS repeats,
             least(1000, word_chars * 10 // greatest(n_words, 1)) AS word_length FROM m),
long AS (SELECT lang, source, unnest(['symbols', 'upper', 'dup_lines', 'repeats', 'word_length']) AS metric,
                unnest([symbols, upper_, dup_lines, repeats, word_length]) AS v FROM f),
sk AS (SELECT lang, source, metric, v, count(*) AS c FROM long GROUP BY ALL),
cum1 AS (SELECT *, sum(c) OVER (PARTITION BY lang, source, metric ORDER BY v) AS r, sum(c) OVER (PARTITION BY lang, source, metric) AS n FROM sk),
q1 AS (SELECT lang, source, metric, max(n) AS n, min(v) FILTER (r * 100 >= n * 25) AS a, min(v) FILTER (r * 100 >= n * 75) AS b FROM cum1 GROUP BY ALL),
sk2 AS (SELECT lang, metric, v, count(*) AS c FROM long GROUP BY ALL),
cum2 AS (SELECT *, sum(c) OVER (PARTITION BY lang, metric ORDER BY v) AS r, sum(c) OVER (PARTITION BY lang, metric) AS n FROM sk2),
q2 AS (SELECT lang, metric, max(n) AS n, min(v) FILTER (r * 100 >= n * 25) AS a, min(v) FILTER (r * 100 >= n * 75) AS b FROM cum2 GROUP BY ALL),
sk3 AS (SELECT metric, v, count(*) AS c FROM long GROUP BY ALL),
cum3 AS (SELECT *, sum(c) OVER (PARTITION BY metric ORDER BY v) AS r, sum(c) OVER (PARTITION BY metric) AS n FROM sk3),
q3 AS (SELECT metric, min(v) FILTER (r * 100 >= n * 25) AS a, min(v) FILTER (r * 100 >= n * 75) AS b FROM cum3 GROUP BY ALL),
tol(metric, t) AS (VALUES ('symbols', 50), ('upper', 200), ('dup_lines', 400), ('repeats', 250), ('word_length', 150)),
lim AS (SELECT q1.lang, q1.source, metric,
               greatest(t, CASE WHEN q1.n >= 100 THEN q1.b + 4 * (q1.b - q1.a) WHEN q2.n >= 100 THEN q2.b + 4 * (q2.b - q2.a)
                                ELSE q3.b + 4 * (q3.b - q3.a) END) AS lim
        FROM q1 JOIN q2 USING (metric) JOIN q3 USING (metric) JOIN tol USING (metric)
        WHERE q1.lang IS NOT DISTINCT FROM q2.lang),
piv AS (SELECT lang, source, max(lim) FILTER (metric = 'symbols') AS l1, max(lim) FILTER (metric = 'upper') AS l2,
               max(lim) FILTER (metric = 'dup_lines') AS l3, max(lim) FILTER (metric = 'repeats') AS l4,
               max(lim) FILTER (metric = 'word_length') AS l5 FROM lim GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND symbols <= l1 AND upper_ <= l2 AND dup_lines <= l3 AND repeats <= l4 AND word_length <= l5 AS kept
FROM f JOIN piv ON f.lang IS NOT DISTINCT FROM piv.lang AND f.source IS NOT DISTINCT FROM piv.source
"""

OP7 = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS k,
             13 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;'))
                + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS len FROM c),
s AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR n = k)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR n = k)::BIGINT AS n_examples
FROM s GROUP BY conv_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s0),
s2 AS (SELECT *, ((sum(ss) OVER ())::DOUBLE * 1.5 - 2.0 * coalesce(sum(ss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                 / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS rn
       FROM s1 WINDOW o AS (ORDER BY ss / w, source ASC NULLS LAST)),
s3 AS (SELECT *, level * w >= 2.0 * ss AS full_ FROM s2),
s4 AS (SELECT source, ss, (CASE WHEN full_ THEN 2.0 * ss ELSE w * (SELECT arg_min(level, rn) FROM s3 WHERE NOT full_) END)::DOUBLE AS target FROM s3),
h AS (SELECT d.source, length(bin(size)) AS oct, sum(size)::DOUBLE AS words, any_value(s4.target) AS target
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source GROUP BY 1, 2),
h1 AS (SELECT *, 1.0::DOUBLE / (4 + oct) AS w FROM h),
h2 AS (SELECT *, sum(words * w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
              coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low
       FROM h1 WINDOW o AS (PARTITION BY source ORDER BY oct)),
h3 AS (SELECT *, CASE WHEN rest > 0 THEN (target - 2.0 * low) / rest ELSE 0.0 END AS rate FROM h2),
h4 AS (SELECT *, rate * w >= 2.0 AS full_ FROM h3),
h5 AS (SELECT source, oct, CASE WHEN full_ THEN 2.0 ELSE least(2.0, greatest(0.0, w * arg_min(rate, oct) FILTER (NOT full_) OVER (PARTITION BY source))) END AS e FROM h4),
r0 AS (SELECT d.*, floor(e)::BIGINT AS sure, e - floor(e) AS p,
              (('0x' || substr(md5('9:' || doc_id::VARCHAR), 1, 15))::BIGINT)::DOUBLE / 1152921504606846976.0 AS u0
       FROM d JOIN h5 ON d.source IS NOT DISTINCT FROM h5.source AND length(bin(d.size)) = h5.oct),
r1 AS (SELECT *, CASE WHEN u0 <= 0 THEN power(2.0, -61) ELSE coalesce(u0, 0.5) END AS u FROM r0),
r2 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS q FROM r1),
r3 AS (SELECT *, q / (1.0 + q) AS v FROM r2),
b AS (SELECT r3.source, any_value(target) - sum(size * sure) AS budget FROM r3 JOIN s4 ON r3.source IS NOT DISTINCT FROM s4.source GROUP BY 1),
t1 AS (SELECT r3.*, budget, v IS NOT NULL AND size > 0 AS can,
              coalesce(sum(CASE WHEN v IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY r3.source ORDER BY v NULLS LAST, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
       FROM r3 JOIN b ON r3.source IS NOT DISTINCT FROM b.source),
t2 AS (SELECT *, can AND pos + size / 2.0 <= budget AS one FROM t1),
t3 AS (SELECT *, budget - sum(CASE WHEN one THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM t2),
t4 AS (SELECT *, can AND NOT one AND size * 4 <= gap AS may FROM t3),
t5 AS (SELECT *, coalesce(sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v NULLS LAST, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos2 FROM t4),
t6 AS (SELECT *, sure + (one OR (may AND pos2 + size / 2.0 <= gap))::BIGINT AS copies FROM t5)
SELECT doc_id, size, ss AS source_size, target, (copies * size)::BIGINT AS taken, copies
FROM t6 JOIN s4 ON t6.source IS NOT DISTINCT FROM s4.source
"""

# crc32 of a string's bytes: bit by bit, polynomial 0xEDB88320
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode({0}))) // 2),
      lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::INT, 2))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"""

OP11 = r"""
WITH RECURSIVE
f AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
             CASE WHEN doc_id IS NOT NULL AND """ + CRC.format("doc_id::VARCHAR") + r""" % 5 = 0
                  THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(octet_length(encode(later)) || ':' || later, '-')) AS found FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS rid FROM l),
inner_ AS (SELECT 0 AS lev, source, pos AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM o
           UNION ALL
           SELECT lev + 1, source, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM inner_ WHERE n > 1 GROUP BY lev, source, i // 16),
sub AS (SELECT source, h AS subroot, lev AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM inner_ WHERE n = 1),
outer_ AS (SELECT 0 AS lev, s AS i, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
           UNION ALL SELECT lev + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM outer_ WHERE n > 1 GROUP BY lev, i // 16),
root AS (SELECT h AS root, lev AS depth FROM outer_ WHERE n = 1),
run AS (SELECT rid, lev, i, h, pos // pow(16, lev)::BIGINT = i AS own FROM o JOIN inner_ ON o.source IS NOT DISTINCT FROM inner_.source
               AND n > 1 AND i // 16 = pos // pow(16, lev + 1)::BIGINT
        UNION ALL
        SELECT rid, depth + lev, i, h, s // pow(16, lev)::BIGINT = i FROM o JOIN sub ON o.source IS NOT DISTINCT FROM sub.source JOIN outer_ ON n > 1 AND i // 16 = s // pow(16, lev + 1)::BIGINT),
proof AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY lev, i) FILTER (NOT own), '')) AS proof_sha256, max(lev) AS top FROM run GROUP BY rid),
fold AS (SELECT rid, 0 AS lev, found AS cur FROM o
         UNION ALL
         SELECT fold.rid, fold.lev + 1, sha256(string_agg(CASE WHEN own THEN cur ELSE h END, '' ORDER BY i))
         FROM fold JOIN run ON fold.rid = run.rid AND fold.lev = run.lev GROUP BY fold.rid, fold.lev)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM o JOIN sub ON o.source IS NOT DISTINCT FROM sub.source CROSS JOIN root LEFT JOIN proof USING (rid)
JOIN fold ON fold.rid = o.rid AND fold.lev = coalesce(proof.top + 1, 0)
"""

OP12 = r"""
WITH RECURSIVE
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT *, """ + CRC.format("key") + r""" % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
      FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS size, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
             coalesce(nullif(substr(role, 1, 1), ''), ' ') AS ini, lead(coalesce(nullif(substr(role, 1, 1), ''), ' ')) OVER w AS next_
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault FROM o),
-- p: what the rows so far end with (n none, s, u, a); t: what a given or inserted turn becomes there
st(p, t) AS (VALUES ('n', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
kp(ini, p, q) AS (VALUES ('s', 'n', 's'), ('u', 'n', 'u'), ('u', 's', 'u'), ('u', 'a', 'u'), ('a', 'u', 'a')),
e AS (SELECT conv_id, n, size, p, p AS q, 2 AS cost, 'D' AS edit, '' AS line FROM f, st
      UNION ALL SELECT conv_id, n, size, p, q, CASE fault WHEN 't' THEN 5 ELSE 0 END, 'K', role || ':' || text || chr(10) FROM f JOIN kp USING (ini) WHERE fault IN ('t', '-')
      UNION ALL SELECT conv_id, n, size, p, t, CASE fault WHEN 't' THEN 6 ELSE 1 END, 'R', CASE t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10) FROM f, st WHERE fault IN ('t', '-')),
ins(p, q, cost, edit, line) AS (SELECT p, p, 0, '', '' FROM st UNION ALL SELECT p, t, 5, 'I', CASE t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10) FROM st
      UNION ALL SELECT st.p, s2.t, 10, 'II', CASE st.t WHEN 'u' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE 'assistant:' || chr(10) || 'user:' || chr(10) END
                FROM st JOIN st AS s2 ON s2.p = st.t),
-- backwards: the least (cost, edits) from each state, the lines with it
b AS (SELECT conv_id, size + 1 AS n, ins.p, arg_min(struct_pack(cost := ins.cost, edit := ins.edit, line := ins.line), struct_pack(cost := ins.cost, edit := ins.edit)) AS v
      FROM (SELECT DISTINCT conv_id, size FROM f), ins WHERE ins.q IN ('n', 'a') GROUP BY ALL
      UNION ALL
      SELECT b.conv_id, b.n - 1, ins.p,
             arg_min(struct_pack(cost := ins.cost + e.cost + v.cost, edit := ins.edit || e.edit || v.edit, line := ins.line || e.line || v.line),
                     struct_pack(cost := ins.cost + e.cost + v.cost, edit := ins.edit || e.edit || v.edit))
      FROM b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.n = b.n - 1 AND e.q = b.p JOIN ins ON ins.q = e.p GROUP BY b.conv_id, b.n, ins.p),
a AS (SELECT conv_id, v.cost AS cost, v.edit AS audit, sha256(rtrim_one(v.line)) AS repaired_sha256 FROM b WHERE n = 1 AND p = 'n'),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (next_ IS NOT NULL AND ini || next_ NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id
""".replace("rtrim_one(v.line)", "CASE WHEN v.line = '' THEN '' ELSE left(v.line, (length(v.line) - 1)::INT) END")

SQL = {"op6_quality_rules": OP6, "op7_chat_format": OP7, "op9_mix_sources": OP9, "op11_merkle_manifest": OP11, "op12_conversation_repair": OP12}
