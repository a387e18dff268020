"""Oracle SQL (DuckDB) for the training-log queries."""

from __future__ import annotations

LOG = """log AS (SELECT CAST(user_id AS BIGINT) AS run, ts, CAST(event_id AS BIGINT) AS seq,
                    CASE WHEN event_type = 'click' THEN 'train' ELSE 'eval' END AS kind, value AS loss
             FROM events WHERE event_type IN ('click', 'purchase'))"""

CARRY = f"""WITH {LOG}
SELECT run, seq, training_loss, validation_loss FROM (
  SELECT run, seq, kind, loss AS validation_loss,
         last_value(CASE WHEN kind = 'train' THEN loss END IGNORE NULLS)
           OVER (PARTITION BY run ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS training_loss
  FROM log) WHERE kind = 'eval'"""

SQL = {
    "loss_carry": CARRY,
    "loss_carry_stream": CARRY,
    "loss_log_snapshots": f"""WITH {LOG},
flog AS (SELECT *, run % 5 AS fold FROM log),
c AS (SELECT *, last_value(CASE WHEN kind = 'train' THEN loss END IGNORE NULLS)
                  OVER (ORDER BY fold, ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS training_loss
      FROM flog),
e AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ts DESC, seq DESC) = 1 AS is_last
      FROM c WHERE kind = 'eval'),
s AS (SELECT e.*, k.snapshot FROM e JOIN (SELECT unnest(range(5)) AS snapshot) k ON k.snapshot >= e.fold
      WHERE NOT (e.is_last AND k.snapshot = e.fold))
SELECT CAST(snapshot AS BIGINT) AS snapshot, count(*) AS n_rows, count(training_loss) AS n_with_train,
       round(sum(training_loss), 6) AS sum_training_loss, round(sum(loss), 6) AS sum_validation_loss,
       CAST(sum(seq) AS BIGINT) AS sum_seq
FROM s GROUP BY snapshot""",
    "best_epoch": """WITH it AS (
  SELECT CAST(user_id AS BIGINT) AS run, value AS metric,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration FROM events)
SELECT run, CAST(iteration AS BIGINT) AS best_iteration, round(metric, 6) AS best_metric FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, iteration) AS rn FROM it WHERE metric > 0)
WHERE rn = 1""",
}
