"""Oracle SQL (DuckDB) for the metric queries: reports on the predictions of the naive Bayes models."""

from __future__ import annotations

from .oracle_evaluate import ratio, report
from .oracle_models import FLAG, FLAGS, HOLD_ALL, JT, PAIR, VALID, nb_sql

SCORED = f"""{PAIR}, {VALID}, {nb_sql([0, 1, 2, 3, 4], [1.0])}, {JT},
scored AS (SELECT uid AS row_id, model AS fold, truth, pred FROM jt),
pc AS (SELECT fold, truth, pred, count(*) AS n FROM scored GROUP BY fold, truth, pred),
cc AS (SELECT fold, CAST(c.class AS BIGINT) AS class,
              sum(CASE WHEN truth = c.class AND pred = c.class THEN n ELSE 0 END) AS tp,
              sum(CASE WHEN pred = c.class AND truth <> c.class THEN n ELSE 0 END) AS fp,
              sum(CASE WHEN truth = c.class AND pred <> c.class THEN n ELSE 0 END) AS fn,
              sum(CASE WHEN truth = c.class THEN n ELSE 0 END) AS support
       FROM pc, (VALUES (0), (1), (2), (3)) c(class) GROUP BY fold, c.class),
acc AS (SELECT fold, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy, count(*) AS n
        FROM scored GROUP BY fold)"""

FLAGGED = f"""{FLAG}, {HOLD_ALL}, {nb_sql([-1], [1.0])},
odds AS (SELECT grp, uid, coalesce(max(score) FILTER (class = 1), -1e9) - coalesce(max(score) FILTER (class = 0), -1e9) AS odds FROM sc GROUP BY grp, uid),
fl AS (SELECT r.uid AS row_id, {', '.join(f"max(class) FILTER (r.grp = 'flag{j}')::BIGINT AS {c}" for j, c in enumerate(FLAGS))},
              {', '.join(f"CASE WHEN 1.0 / (1.0 + exp(-least(700.0, greatest(-700.0, max(odds) FILTER (r.grp = 'flag{j}'))))) > 0.5 THEN 1 ELSE 0 END AS pred_{c}"
                         for j, c in enumerate(FLAGS))}
       FROM odds o JOIN rows r ON r.grp = o.grp AND r.uid = o.uid GROUP BY r.uid),
fc AS ({' UNION ALL '.join(
    f"SELECT CAST({j} AS BIGINT) AS class, sum(CASE WHEN {c} = 1 AND pred_{c} = 1 THEN 1 ELSE 0 END) AS tp, "
    f"sum(CASE WHEN {c} = 0 AND pred_{c} = 1 THEN 1 ELSE 0 END) AS fp, "
    f"sum(CASE WHEN {c} = 1 AND pred_{c} = 0 THEN 1 ELSE 0 END) AS fn, sum({c}) AS support FROM fl"
    for j, c in enumerate(FLAGS))})"""

WIDE_COLS = []
for code, slug in [(0, "bug_report"), (1, "feature_request"), (2, "rating"), (3, "user_experience")]:
    for m, src in (("p", "precision"), ("r", "recall"), ("f1", "f1")):
        WIDE_COLS.append(f"max(CASE WHEN class = {code} THEN {src} END) AS {slug}_{m}")

SQL = {
    "accuracy": f"""{SCORED}
SELECT fold, round(accuracy, 6) AS accuracy, n FROM acc""",
    "confusion_counts": f"""{SCORED}
SELECT fold, class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, support::BIGINT AS support FROM cc""",
    "class_report": f"""{SCORED},
tot AS (SELECT class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
               sum(support)::BIGINT AS support FROM cc GROUP BY class)
SELECT class, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM ({report('tot')})""",
    "report_averages": f"""{SCORED},
rep AS ({report('cc')} WHERE support + fp > 0)
SELECT fold,
       round(avg(precision), 6) AS macro_precision,
       round({ratio('sum(precision * support)', 'sum(support)')}, 6) AS weighted_precision,
       round(avg(recall), 6) AS macro_recall,
       round({ratio('sum(recall * support)', 'sum(support)')}, 6) AS weighted_recall,
       round(avg(f1), 6) AS macro_f1,
       round({ratio('sum(f1 * support)', 'sum(support)')}, 6) AS weighted_f1
FROM rep GROUP BY fold""",
    "wide_metrics": f"""{SCORED},
rep AS ({report('cc')}),
w AS (SELECT fold, {', '.join(WIDE_COLS)} FROM rep GROUP BY fold)
SELECT w.fold, round(a.accuracy, 6) AS accuracy,
       {', '.join(f"round(w.{c.split(' AS ')[1]}, 6) AS {c.split(' AS ')[1]}" for c in WIDE_COLS)}
FROM w JOIN acc a ON w.fold = a.fold""",
    "best_fold": f"""{SCORED}
SELECT fold, round(accuracy, 6) AS accuracy, n FROM acc WHERE accuracy > 0
ORDER BY accuracy DESC, fold LIMIT 1""",
    "fold_scores": f"""{SCORED}
SELECT string_agg(printf('%d:%.6f', fold, accuracy), ',' ORDER BY fold) AS scores FROM acc""",
    "sigmoid_flags": f"""{FLAGGED}
SELECT row_id, {', '.join(f'pred_{c}::BIGINT AS pred_{c}' for c in FLAGS)} FROM fl""",
    "micro_prf": f"""{FLAGGED},
p AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM fc)
SELECT tp, fp, fn, round({ratio('tp', 'tp + fp')}, 6) AS micro_precision,
       round({ratio('tp', 'tp + fn')}, 6) AS micro_recall,
       round({ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS micro_f1 FROM p""",
    "flag_report": f"""{FLAGGED}
SELECT class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, support::BIGINT AS support,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       ['bug report', 'user experience', 'rating', 'feature request'][class + 1] AS flag
FROM ({report('fc')})""",
    "samples_avg": f"""{FLAGGED},
r AS (SELECT {' + '.join(f'{c} * pred_{c}' for c in FLAGS)} AS b, {' + '.join(FLAGS)} AS t,
             {' + '.join(f'pred_{c}' for c in FLAGS)} AS p FROM fl)
SELECT round(avg({ratio('b', 'p')}), 6) AS samples_precision, round(avg({ratio('b', 't')}), 6) AS samples_recall,
       round(avg({ratio('2 * b', 't + p')}), 6) AS samples_f1 FROM r""",
    "label_decode": f"""{SCORED}
SELECT s.row_id, s.pred::BIGINT AS pred, d.label AS pred_label FROM scored s LEFT JOIN dict d ON s.pred = d.code""",
    "argmax_label": """WITH e AS (SELECT vec_id::BIGINT AS vec_id, label, embedding FROM embeddings),
x AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM e),
c AS (SELECT label, list(m ORDER BY dim) AS mean FROM (SELECT label, dim, avg(x) AS m FROM x GROUP BY label, dim) GROUP BY label),
n AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS place FROM c),
d AS (SELECT e.vec_id, n.place, round(list_sum(list_transform(range(len(n.mean)), lambda i: (e.embedding[i + 1]::DOUBLE - n.mean[i + 1]) ** 2)), 6) AS dist FROM e CROSS JOIN n)
SELECT vec_id, arg_min(place, struct_pack(d := dist, p := place))::BIGINT AS pred FROM d GROUP BY vec_id""",
}
