"""Oracle SQL (DuckDB) for the split and metric queries."""

from __future__ import annotations

from .oracle_prep import BASE, MULTI, PAIRS


def H(seed, col: str) -> str:
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


def HI(seed, col: str) -> str:
    return f"CAST(('0x' || substr({H(seed, col)}, 1, 15)) AS BIGINT)"


PRESENT = f"""{BASE},
present AS (SELECT row_id, label, new_label FROM coded WHERE review IS NOT NULL AND review <> '')"""


def alloc(src: str) -> str:
    return f"""cls AS (SELECT label, count(*) AS nc FROM {src} GROUP BY label),
tot AS (SELECT sum(nc) AS n, sum(nc) - (sum(nc) + 4) // 5 AS ntrain FROM cls),
al AS (SELECT label, nc, (nc * ntrain) // n AS fl, (nc * ntrain) % n AS rem, ntrain FROM cls, tot),
al2 AS (SELECT *, ntrain - sum(fl) OVER () AS leftover,
               row_number() OVER (ORDER BY rem DESC, label) AS rr FROM al),
quota AS (SELECT label, fl + CASE WHEN rr <= leftover THEN 1 ELSE 0 END AS t FROM al2)"""


STRAT = f"""{PRESENT},
{alloc('present')},
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY label ORDER BY {H(42, 'row_id')}, row_id) AS r
           FROM present p),
strat AS (SELECT r.row_id, r.label, r.new_label,
                 CASE WHEN r.r <= q.t THEN 'train' ELSE 'test' END AS split
          FROM ranked r JOIN quota q ON r.label = q.label)"""

RANDOM = f"""{PRESENT},
rnd AS (SELECT row_id, label,
               CASE WHEN row_number() OVER (ORDER BY {H(42, 'row_id')}, row_id)
                         <= count(*) OVER () - (count(*) OVER () + 4) // 5 THEN 'train' ELSE 'test' END AS split
        FROM present)"""

FOLDED = f"""{PRESENT},
folds AS (SELECT row_id, label, new_label,
                 (row_number() OVER (ORDER BY label, {H(42, 'row_id')}, row_id) - 1) % 5 AS fold
          FROM present)"""


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END"


def report(src: str) -> str:
    return (f"SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, "
            f"{ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM {src}")


SQL = {
    "split_stratified": f"""WITH {STRAT.removeprefix('WITH ')}
SELECT row_id, label, split FROM strat""",
    "split_random": f"""WITH {RANDOM.removeprefix('WITH ')}
SELECT row_id, split FROM rnd""",
    "folds_stratified": f"""WITH {STRAT.removeprefix('WITH ')}
SELECT row_id, label, (row_number() OVER (ORDER BY label, {H(42, 'row_id')}, row_id) - 1) % 5 AS fold
FROM strat WHERE split = 'train'""",
    "folds_random": f"""WITH {RANDOM.removeprefix('WITH ')}
SELECT row_id, (row_number() OVER (ORDER BY {H(42, 'row_id')}, row_id) - 1) % 2 AS fold
FROM rnd WHERE split = 'train'""",
    "fold_train_val": f"""WITH {FOLDED.removeprefix('WITH ')}
SELECT r.round, CASE WHEN f.fold = r.round THEN 'val' ELSE 'train' END AS role, count(*) AS n,
       sum(f.row_id)::BIGINT AS sum_id
FROM folds f, (SELECT unnest(range(5)) AS round) r GROUP BY 1, 2""",
    "label_encode": f"""WITH {PAIRS},
dict AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
         FROM (SELECT DISTINCT label FROM pairs WHERE label IS NOT NULL))
SELECT p.row_id, p.label, d.code::BIGINT AS label_code FROM pairs p JOIN dict d ON p.label = d.label""",
}
