"""Oracle SQL (DuckDB) for the naive Bayes queries: the same model written as plain SQL."""

from __future__ import annotations

import math

from ..functions.constants import SEARCH_CALLS, SEARCH_SPACE, SEED
from .oracle_evaluate import HI, H, ratio
from .oracle_prep import MULTI, PAIRS, RAW, RECODED
from .oracle_text import tok

FLAGS = ["bug_report", "user_experience", "rating", "feature_request"]


def alloc_sql(src: str, groups: list[str]) -> str:
    g = ", ".join(groups)
    gp = f"PARTITION BY {g}" if groups else ""
    gsel = f"{g}, " if groups else ""
    return f"""acls AS (SELECT {gsel}label, count(*) AS nc FROM {src} GROUP BY {gsel}label),
al AS (SELECT *, sum(nc) OVER ({gp}) AS n FROM acls),
al1 AS (SELECT *, n - (n + 4) // 5 AS ntrain FROM al),
al2 AS (SELECT *, (nc * ntrain) // n AS fl, (nc * ntrain) % n AS rem FROM al1),
al3 AS (SELECT *, ntrain - sum(fl) OVER ({gp}) AS leftover,
               row_number() OVER ({gp} ORDER BY rem DESC, label) AS rr FROM al2),
quota AS (SELECT {gsel}label, fl + CASE WHEN rr <= leftover THEN 1 ELSE 0 END AS t FROM al3)"""


def strat_sql(src: str, key: str, groups: list[str], folds: int) -> str:
    """CTEs ending in ``srows(<src cols>, split, fold)``: stratified split and folds."""
    part = ", ".join(groups + ["label"])
    on = " AND ".join(f"r.{c} = q.{c}" for c in groups + ["label"])
    gord = "".join(f"{c}, " for c in groups)
    return f"""{alloc_sql(src, groups)},
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY {part} ORDER BY {H(SEED, key)}, {key}) AS r FROM {src} s),
sp AS (SELECT r.*, CASE WHEN r.r <= q.t THEN 'train' ELSE 'test' END AS split FROM ranked r JOIN quota q ON {on}),
srows AS (SELECT *, CASE WHEN split = 'train' THEN CAST((row_number() OVER (
                   PARTITION BY split ORDER BY {gord}label, {H(SEED, key)}, {key}) - 1) % {folds} AS INTEGER) END AS fold
          FROM sp)"""


def nb_sql(models: list[int], alphas: list[float]) -> str:
    """CTEs over ``rows(grp, uid, class, split, fold)``, ``tf(uid, term, tf)`` and
    ``targets(grp, uid, model)`` ending in ``preds(grp, uid, model, alpha, pred)`` and ``cls``, ``ck``."""
    mlist = ", ".join(str(m) for m in models)
    alist = ", ".join(f"CAST({a!r} AS DOUBLE)" for a in alphas)
    return f"""train AS (SELECT grp, uid, class, coalesce(fold, -2) AS fold FROM rows WHERE split = 'train'),
pf AS (SELECT t.grp, t.fold, t.class, f.term, sum(f.tf) AS c FROM tf f JOIN train t ON f.uid = t.uid
       GROUP BY t.grp, t.fold, t.class, f.term),
pa AS (SELECT grp, class, term, sum(c) AS c FROM pf GROUP BY grp, class, term),
mdl AS (SELECT unnest([{mlist}]) AS model),
ck AS (SELECT a.grp, m.model, a.class, a.term, a.c - coalesce(f.c, 0) AS c
       FROM pa a CROSS JOIN mdl m
       LEFT JOIN pf f ON f.grp = a.grp AND f.fold = m.model AND f.class = a.class AND f.term = a.term
       WHERE a.c - coalesce(f.c, 0) > 0),
vk AS (SELECT grp, model, count(DISTINCT term) AS vsize FROM ck GROUP BY grp, model),
nk AS (SELECT grp, model, class, sum(c) AS ntok FROM ck GROUP BY grp, model, class),
dfo AS (SELECT grp, fold, class, count(*) AS nd FROM train GROUP BY grp, fold, class),
dal AS (SELECT grp, class, sum(nd) AS nd FROM dfo GROUP BY grp, class),
dk AS (SELECT a.grp, m.model, a.class, a.nd - coalesce(f.nd, 0) AS nd
       FROM dal a CROSS JOIN mdl m LEFT JOIN dfo f ON f.grp = a.grp AND f.fold = m.model AND f.class = a.class
       WHERE a.nd - coalesce(f.nd, 0) > 0),
dn AS (SELECT grp, model, sum(nd) AS n FROM dk GROUP BY grp, model),
cls AS (SELECT d.grp, d.model, d.class, d.nd, ln(d.nd / n.n) AS log_prior,
               coalesce(k.ntok, 0) AS ntok, coalesce(v.vsize, 0) AS vsize
        FROM dk d JOIN dn n ON n.grp = d.grp AND n.model = d.model
        LEFT JOIN nk k ON k.grp = d.grp AND k.model = d.model AND k.class = d.class
        LEFT JOIN vk v ON v.grp = d.grp AND v.model = d.model),
tt AS (SELECT g.grp, g.uid, g.model, f.term, f.tf FROM targets g JOIN tf f ON f.uid = g.uid),
voc AS (SELECT DISTINCT grp, model, term FROM ck),
lv AS (SELECT tt.grp, tt.uid, tt.model, sum(tt.tf) AS l FROM tt
       JOIN voc v ON v.grp = tt.grp AND v.model = tt.model AND v.term = tt.term GROUP BY tt.grp, tt.uid, tt.model),
alp AS (SELECT unnest([{alist}]) AS alpha),
sps AS (SELECT tt.grp, tt.uid, tt.model, k.class, a.alpha, sum(tt.tf * ln((k.c + a.alpha) / a.alpha)) AS s
        FROM tt JOIN ck k ON k.grp = tt.grp AND k.model = tt.model AND k.term = tt.term CROSS JOIN alp a
        GROUP BY tt.grp, tt.uid, tt.model, k.class, a.alpha),
sc AS (SELECT g.grp, g.uid, g.model, c.class, a.alpha,
              round(c.log_prior + coalesce(lv.l, 0) * (ln(a.alpha) - ln(c.ntok + a.alpha * c.vsize))
                    + coalesce(sps.s, 0), 6) AS score
       FROM targets g JOIN cls c ON c.grp = g.grp AND c.model = g.model CROSS JOIN alp a
       LEFT JOIN lv ON lv.grp = g.grp AND lv.uid = g.uid AND lv.model = g.model
       LEFT JOIN sps ON sps.grp = g.grp AND sps.uid = g.uid AND sps.model = g.model AND sps.class = c.class
                    AND sps.alpha = a.alpha),
preds AS (SELECT grp, uid, model, alpha, class AS pred FROM (
            SELECT *, row_number() OVER (PARTITION BY grp, uid, model, alpha ORDER BY score DESC, class) AS rn
            FROM sc) WHERE rn = 1)"""


def _tf_sql(src: str) -> str:
    return f"""tf AS (SELECT uid, lower(term) AS term, count(*) AS tf
       FROM (SELECT uid, unnest({tok('review', clean=True)}) AS term FROM {src}) GROUP BY uid, lower(term))"""


PAIR = f"""WITH {PAIRS},
pp AS (SELECT row_id, review, label FROM pairs WHERE review IS NOT NULL AND review <> ''),
dict AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM pp)),
src AS (SELECT p.row_id, p.label, d.code FROM pp p JOIN dict d ON p.label = d.label),
{strat_sql('src', 'row_id', [], 5)},
rows AS (SELECT 'pairs' AS grp, row_id AS uid, code AS class, split, fold FROM srows),
{_tf_sql('(SELECT row_id AS uid, review FROM pp)')}"""

FLAG = f"""WITH {MULTI},
mm AS (SELECT * FROM multi WHERE review IS NOT NULL AND review <> ''),
rs AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {H(SEED, 'row_id')}, row_id)
                          <= count(*) OVER () - (count(*) OVER () + 4) // 5 THEN 'train' ELSE 'test' END AS split
       FROM mm),
rf AS (SELECT *, CASE WHEN split = 'train' THEN CAST((row_number() OVER (
                   PARTITION BY split ORDER BY {H(SEED, 'row_id')}, row_id) - 1) % 2 AS INTEGER) END AS fold FROM rs),
rows AS ({' UNION ALL '.join(f"SELECT 'flag{j}' AS grp, row_id AS uid, {c} AS class, split, fold FROM rf"
                              for j, c in enumerate(FLAGS))}),
{_tf_sql('(SELECT row_id AS uid, review FROM mm)')}"""

VALID = "targets AS (SELECT grp, uid, fold AS model FROM rows WHERE split = 'train')"
HOLD_ALL = "targets AS (SELECT grp, uid, -1 AS model FROM rows WHERE split = 'test')"


def _cands() -> str:
    cols = ["c.candidate"]
    two60 = "CAST(1152921504606846976 AS DOUBLE)"
    for dim, (kind, lo, hi) in SEARCH_SPACE.items():
        u = f"(CAST({HI(f'{SEED}-{dim}', 'c.candidate')} AS DOUBLE) / {two60})"
        if kind == "uniform":
            v = f"round({lo!r} + {u} * {hi - lo!r}, 10)"
        elif kind == "int":
            v = f"CAST({lo} + floor({u} * {hi - lo + 1}) AS BIGINT)"
        else:
            v = f"CAST(round(exp({math.log(lo)!r} + {u} * {math.log(hi) - math.log(lo)!r})) AS BIGINT)"
        cols.append(f"{v} AS {dim}")
    return (f"cands AS (SELECT {', '.join(cols)} FROM (SELECT CAST(unnest(range({SEARCH_CALLS})) AS BIGINT) "
            f"AS candidate) c),\ncand AS (SELECT *, round(weight_decay * 10, 6) AS alpha FROM cands)")


def _report(src: str) -> str:
    return (f"SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, "
            f"{ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM {src}")


def _conf(src: str, by: str, classes: str | None = None) -> str:
    """Per-class confusion counts of ``src(<by>, truth, pred)``; classes seen, or the given list."""
    if classes is None:
        cl = (f"(SELECT DISTINCT {by}, truth AS class FROM {src} UNION "
              f"SELECT DISTINCT {by}, pred FROM {src})")
    else:
        cl = f"(SELECT DISTINCT {by}, unnest({classes}) AS class FROM {src})"
    return (f"SELECT k.{by}, k.class, sum(CASE WHEN s.truth = k.class AND s.pred = k.class THEN 1 ELSE 0 END) AS tp, "
            f"sum(CASE WHEN s.pred = k.class AND s.truth <> k.class THEN 1 ELSE 0 END) AS fp, "
            f"sum(CASE WHEN s.truth = k.class AND s.pred <> k.class THEN 1 ELSE 0 END) AS fn, "
            f"sum(CASE WHEN s.truth = k.class THEN 1 ELSE 0 END) AS support "
            f"FROM {cl} k JOIN {src} s ON s.{by} = k.{by} GROUP BY k.{by}, k.class")


def _avgs(rep: str, by: str) -> str:
    return (f"SELECT {by}, round(avg(f1), 6) AS macro_f1, "
            f"round({ratio('sum(f1 * support)', 'sum(support)')}, 6) AS weighted_f1 FROM ({rep}) GROUP BY {by}")


JT = "jt AS (SELECT p.grp, p.uid, p.model, p.alpha, p.pred, r.class AS truth FROM preds p JOIN rows r ON r.grp = p.grp AND r.uid = p.uid)"

WIDE = []
for code, slug in [(0, "bug_report"), (1, "feature_request"), (2, "rating"), (3, "user_experience")]:
    for m, src in (("p", "precision"), ("r", "recall"), ("f1", "f1")):
        WIDE.append(f"round(max(CASE WHEN class = {code} THEN {src} END), 6) AS {slug}_{m}")


def _micro(src: str, by: str) -> str:
    return (f"SELECT {by}, tp, fp, fn, round({ratio('tp', 'tp + fp')}, 6) AS micro_precision, "
            f"round({ratio('tp', 'tp + fn')}, 6) AS micro_recall, "
            f"round({ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS micro_f1 FROM ("
            f"SELECT {by}, sum(CASE WHEN truth = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, "
            f"sum(CASE WHEN truth = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, "
            f"sum(CASE WHEN truth = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn FROM {src} GROUP BY {by})")


def _best(cv: str, metric: str) -> str:
    return (f"best AS (SELECT coalesce((SELECT model FROM {cv} WHERE {metric} > 0 "
            f"ORDER BY {metric} DESC, model LIMIT 1), -1) AS model)")


def _stacked() -> str:
    return f"""WITH {RAW}, {RECODED}, {PAIRS},
st AS (SELECT 'reviews' AS dataset, CAST(row_id AS VARCHAR) AS row_id, review, label FROM recoded
       UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text, role
       FROM conversations
       UNION ALL SELECT 'pairs', CAST(row_id AS VARCHAR), review, label FROM pairs),
sp0 AS (SELECT dataset, dataset || ':' || CAST(row_id AS VARCHAR) AS uid, review, label FROM st
        WHERE review IS NOT NULL AND review <> ''),
codes AS (SELECT dataset, label, row_number() OVER (PARTITION BY dataset ORDER BY label) - 1 AS code
          FROM (SELECT DISTINCT dataset, label FROM sp0)),
coded AS (SELECT s.*, c.code FROM sp0 s JOIN codes c ON c.dataset = s.dataset AND c.label = s.label),
bal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, label
                                                    ORDER BY length(review) DESC NULLS LAST, uid) AS rk FROM coded)
        WHERE rk <= 100),
both_ AS (SELECT dataset || '|Balanced' AS grp, uid, label, code FROM bal
          UNION ALL SELECT dataset || '|Unbalanced', uid, label, code FROM coded),
{strat_sql('both_', 'uid', ['grp'], 5)},
rows AS (SELECT grp, uid, code AS class, split, fold FROM srows),
{_tf_sql('(SELECT uid, review FROM coded)')}"""


SQL = {
    "nb_term_counts": f"""{PAIR}, {HOLD_ALL}, {nb_sql([-1], [1.0])}
SELECT c.class::BIGINT AS class, c.nd::BIGINT AS nd, c.ntok::BIGINT AS ntok, c.vsize::BIGINT AS vsize,
       coalesce(t.n_terms, 0)::BIGINT AS n_terms
FROM cls c LEFT JOIN (SELECT class, count(*) AS n_terms FROM ck GROUP BY class) t ON t.class = c.class""",
    "nb_predict": f"""{PAIR}, {HOLD_ALL}, {nb_sql([-1], [1.0])}, {JT}
SELECT uid::BIGINT AS row_id, truth::BIGINT AS truth, pred::BIGINT AS pred FROM jt""",
    "cv_multiclass": f"""{PAIR}, {VALID}, {nb_sql([0, 1, 2, 3, 4], [1.0])}, {JT},
acc AS (SELECT model, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy, count(*) AS n
        FROM jt GROUP BY model),
av AS ({_avgs(_report(f"({_conf('jt', 'model')})"), 'model')})
SELECT a.model::BIGINT AS fold, round(a.accuracy, 6) AS accuracy, a.n, v.macro_f1, v.weighted_f1
FROM acc a JOIN av v ON v.model = a.model""",
    "holdout_multiclass": f"""{PAIR},
targets AS (SELECT grp, uid, fold AS model FROM rows WHERE split = 'train'
            UNION ALL SELECT grp, uid, m.model FROM rows, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS model) m
            WHERE split = 'test'),
{nb_sql([-1, 0, 1, 2, 3, 4], [1.0])}, {JT},
cvacc AS (SELECT model, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS accuracy
          FROM jt j WHERE EXISTS (SELECT 1 FROM rows r WHERE r.uid = j.uid AND r.split = 'train') GROUP BY model),
{_best('cvacc', 'accuracy')},
hj AS (SELECT j.* FROM jt j JOIN rows r ON r.uid = j.uid AND r.split = 'test' JOIN best b ON b.model = j.model),
rep AS ({_report(f"({_conf('hj', 'model', '[0, 1, 2, 3]')})")})
SELECT (SELECT model FROM best)::BIGINT AS best_fold,
       (SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) FROM hj) AS accuracy,
       (SELECT count(*) FROM hj) AS n, {', '.join(WIDE)}
FROM rep""",
    "nb_multilabel": f"""{FLAG}, {HOLD_ALL}, {nb_sql([-1], [1.0])}, {JT}
SELECT uid::BIGINT AS row_id, grp AS flag, truth::BIGINT AS truth, pred::BIGINT AS pred FROM jt""",
    "cv_multilabel": f"""{FLAG}, {VALID}, {nb_sql([0, 1], [1.0])}, {JT}
SELECT model::BIGINT AS fold, tp, fp, fn, micro_precision, micro_recall, micro_f1 FROM ({_micro('jt', 'model')})""",
    "holdout_multilabel": f"""{FLAG},
targets AS (SELECT grp, uid, fold AS model FROM rows WHERE split = 'train'
            UNION ALL SELECT grp, uid, m.model FROM rows, (SELECT unnest([-1, 0, 1]) AS model) m
            WHERE split = 'test'),
{nb_sql([-1, 0, 1], [1.0])}, {JT},
tr AS (SELECT j.* FROM jt j JOIN rows r ON r.grp = j.grp AND r.uid = j.uid AND r.split = 'train'),
cvm AS ({_micro('tr', 'model')}),
{_best('cvm', 'micro_f1')},
hj AS (SELECT j.* FROM jt j JOIN rows r ON r.grp = j.grp AND r.uid = j.uid AND r.split = 'test'
       JOIN best b ON b.model = j.model),
per AS (SELECT uid, sum(truth * pred) AS b, sum(truth) AS t, sum(pred) AS p FROM hj GROUP BY uid),
mi AS ({_micro('hj', 'model')})
SELECT mi.model::BIGINT AS best_fold, mi.tp, mi.fp, mi.fn, mi.micro_precision, mi.micro_recall, mi.micro_f1,
       (SELECT round(avg({ratio('b', 'p')}), 6) FROM per) AS samples_precision,
       (SELECT round(avg({ratio('b', 't')}), 6) FROM per) AS samples_recall,
       (SELECT round(avg({ratio('2 * b', 't + p')}), 6) FROM per) AS samples_f1
FROM mi""",
    "run_matrix": f"""{_stacked()},
targets AS (SELECT grp, uid, fold AS model FROM rows WHERE split = 'train'
            UNION ALL SELECT grp, uid, m.model FROM rows, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS model) m
            WHERE split = 'test'),
{nb_sql([-1, 0, 1, 2, 3, 4], [1.0])}, {JT},
cvacc AS (SELECT j.grp, j.model, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS accuracy
          FROM jt j JOIN rows r ON r.grp = j.grp AND r.uid = j.uid AND r.split = 'train' GROUP BY j.grp, j.model),
best AS (SELECT g.grp, coalesce(b.model, -1) AS model FROM (SELECT DISTINCT grp FROM rows) g LEFT JOIN (
           SELECT grp, model FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY accuracy DESC, model) AS rn
                                   FROM cvacc WHERE accuracy > 0) WHERE rn = 1) b ON b.grp = g.grp),
hj AS (SELECT j.* FROM jt j JOIN rows r ON r.grp = j.grp AND r.uid = j.uid AND r.split = 'test'
       JOIN best b ON b.grp = j.grp AND b.model = j.model),
hj2 AS (SELECT grp || '#' || CAST(model AS VARCHAR) AS gm, * FROM hj),
av AS ({_avgs(_report(f"({_conf('hj2', 'gm')})"), 'gm')})
SELECT split_part(h.grp, '|', 1) AS dataset, split_part(h.grp, '|', 2) AS variant, h.model::BIGINT AS best_fold,
       count(*) AS n_test, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy,
       max(v.macro_f1) AS macro_f1
FROM hj2 h JOIN av v ON v.gm = h.gm GROUP BY h.grp, h.model""",
}


def _all_avgs(rep: str, by: str) -> str:
    cols = []
    for m in ("precision", "recall", "f1"):
        cols.append(f"round(avg({m}), 6) AS macro_{m}")
        cols.append(f"round({ratio(f'sum({m} * support)', 'sum(support)')}, 6) AS weighted_{m}")
    return f"SELECT {by}, {', '.join(cols)} FROM ({rep}) GROUP BY {by}"


def _class_table(src: str) -> str:
    """One row a model: accuracy, every class, averages."""
    rep = _report(f"({_conf(src, 'model', '[0, 1, 2, 3]')})")
    return f"""(SELECT model, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy, count(*) AS n FROM {src} GROUP BY model)
JOIN (SELECT model, {', '.join(WIDE)} FROM ({rep}) GROUP BY model) USING (model) JOIN ({_all_avgs(rep, 'model')}) USING (model)"""


def _flag_table(src: str) -> str:
    wide = [f"round(max(CASE WHEN class = {j} THEN {col} END), 6) AS {flag}_{m}" for j, flag in enumerate(FLAGS)
            for m, col in (("p", "precision"), ("r", "recall"), ("f1", "f1"))]
    counts = f"""(SELECT model, CAST(substr(grp, 5) AS INTEGER) AS class, count(*) FILTER (truth = 1 AND pred = 1) AS tp,
        count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn, sum(truth) AS support FROM {src} GROUP BY ALL)"""
    rep = _report(counts)
    return f"""({_micro(src, 'model')}) JOIN (SELECT model, {', '.join(wide)} FROM ({rep}) GROUP BY model) USING (model)
JOIN ({_all_avgs(rep, 'model')}) USING (model)
JOIN (SELECT model, round(avg({ratio('b', 'p')}), 6) AS samples_precision, round(avg({ratio('b', 't')}), 6) AS samples_recall,
             round(avg({ratio('2 * b', 't + p')}), 6) AS samples_f1
      FROM (SELECT model, uid, sum(truth * pred) AS b, sum(truth) AS t, sum(pred) AS p FROM {src} GROUP BY model, uid) GROUP BY model) USING (model)"""


_ONE = "SELECT * EXCLUDE (model), (model + 1)::BIGINT AS fold FROM "
SQL["cv_multiclass_report"] = f"""{PAIR}, {VALID}, {nb_sql([0, 1, 2, 3, 4], [1.0])}, {JT}
{_ONE}{_class_table('jt')}"""
SQL["cv_multilabel_report"] = f"""{FLAG}, {VALID}, {nb_sql([0, 1], [1.0])}, {JT}
{_ONE}{_flag_table('jt')}"""
SQL["holdout_multiclass_report"] = SQL["holdout_multiclass"].split("rep AS (")[0].rstrip().rstrip(",") + f"\n{_ONE}{_class_table('hj')}"
SQL["holdout_multilabel_report"] = SQL["holdout_multilabel"].split("per AS (SELECT uid")[0].rstrip().rstrip(",") + f"\n{_ONE}{_flag_table('hj')}"

SQL["embed_means"] = f"""WITH src AS (SELECT vec_id::BIGINT AS vec_id, label, embedding FROM embeddings),
{strat_sql('src', 'vec_id', [], 5)},
e AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM srows WHERE split = 'train'),
m AS (SELECT label, dim, avg(x) AS m FROM e GROUP BY label, dim),
c AS (SELECT label, list(m ORDER BY dim) AS mean FROM m GROUP BY label),
d AS (SELECT s.vec_id, s.label AS truth, c.label AS pred,
             round(list_sum(list_transform(range(len(c.mean)), lambda i: (s.embedding[i + 1]::DOUBLE - c.mean[i + 1]) ** 2)), 6) AS dist
      FROM srows s CROSS JOIN c WHERE s.split = 'test')
SELECT vec_id, truth::BIGINT AS truth, arg_min(pred, struct_pack(d := dist, p := pred))::BIGINT AS pred FROM d GROUP BY vec_id, truth"""

# hp_search needs the candidate smoothing values as literals of the scoring; they are computed here
# with the same rule the SQL uses, so the SQL stays a single statement.


def _alphas() -> list[float]:
    import hashlib
    out = []
    lo, hi = SEARCH_SPACE["weight_decay"][1:]
    for c in range(SEARCH_CALLS):
        h = hashlib.md5(f"{SEED}-weight_decay:{c}".encode()).hexdigest()
        u = float(int(h[:15], 16)) / float(1 << 60)
        wd = round(lo + u * (hi - lo), 10)
        out.append(round(wd * 10, 6))
    return out


SQL["hp_search"] = f"""{PAIR}, {HOLD_ALL}, {nb_sql([-1], _alphas())}, {JT}, {_cands()},
acc AS (SELECT alpha, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM jt GROUP BY alpha),
hs AS (SELECT c.*, round(a.accuracy, 6) AS accuracy FROM cand c JOIN acc a ON round(a.alpha, 6) = round(c.alpha, 6))
SELECT *, CAST(row_number() OVER (ORDER BY accuracy DESC, candidate) = 1 AS BIGINT) AS is_best FROM hs"""
