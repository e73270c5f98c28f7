"""The SQL spelling: run SQL text over DataFrames, with named parameters.

``run_sql(spark, text, args, contracts=df, …)`` substitutes each DataFrame
for its ``{name}`` placeholder and binds ``:name`` parameters, so no temporary
view or string-built literal is needed.  Catalyst plans the text exactly like
the DataFrame code.  ``LOST_BY_MODULE_MONTH`` is the flagship dataset in this
spelling; the classification CASE is generated from the same rule list as
the DataFrame version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attrition.functions import rules
from attrition.functions.dates import Window, last_of_month, shift_months


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _case(col: str, rule_list, default: str) -> str:
    whens = " ".join(f"WHEN {col} LIKE {_q(p)} THEN {_q(c)}" for p, c in rule_list)
    return f"CASE {whens} ELSE {_q(default)} END"


def _not_like_all(col: str, patterns) -> str:
    return " AND ".join(f"{col} NOT LIKE {_q(p)}" for p in patterns)


def run_sql(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """``spark.sql`` with DataFrame placeholders (``{name}``) and named parameters (``:name``)."""
    return spark.sql(text, args=args or {}, **frames)


LOST_BY_MODULE_MONTH = f"""
WITH tagged AS (
  SELECT client_id, product, inline(array_compact(array(
    CASE WHEN end_date IS NOT NULL
          AND (cancel_date BETWEEN :lo AND :hi OR (cancel_date IS NULL AND end_date BETWEEN :lo AND :hi))
          AND {_not_like_all('product', rules.ONE_OFF_PATTERNS)}
         THEN named_struct('month', trunc(coalesce(cancel_date, end_date), 'MM'), 'amount', amount, 'ended', 1,
                           'month_end', coalesce(cancel_date, end_date) = last_day(coalesce(cancel_date, end_date)),
                           'restarted', false) END,
    CASE WHEN start_date BETWEEN :next AND :until
         THEN named_struct('month', add_months(trunc(start_date, 'MM'), -1), 'amount', CAST(NULL AS DECIMAL(29, 9)),
                           'ended', 0, 'month_end', false, 'restarted', true) END)))
  FROM {{contracts}}
  WHERE (end_date IS NOT NULL
         AND (cancel_date BETWEEN :lo AND :hi OR (cancel_date IS NULL AND end_date BETWEEN :lo AND :hi)))
     OR start_date BETWEEN :next AND :until
),
open_latest AS (
  SELECT m.client_id, m.product, max(struct(m.start_date, m.amount, c.cancel_date)) AS top
  FROM {{contracts}} m
  JOIN (SELECT DISTINCT client_id, cancel_date FROM {{clients}} WHERE cancel_date BETWEEN :lo AND :hi) c
    ON m.client_id = c.client_id
  WHERE m.end_date IS NULL AND {_not_like_all('m.product', rules.ONE_OFF_PATTERNS)}
  GROUP BY m.client_id, m.product
),
per_key AS (
  SELECT client_id, product, month, sum(amount) AS amount, sum(ended) AS ended,
         max(month_end) AS month_end, max(restarted) AS restarted
  FROM (SELECT * FROM tagged
        UNION ALL
        SELECT client_id, product, trunc(top.cancel_date, 'MM'), top.amount, 1,
               top.cancel_date = last_day(top.cancel_date), false
        FROM open_latest)
  GROUP BY client_id, product, month
)
SELECT month,
       lower({_case('product', rules.MODULE_RULES, rules.MODULE_DEFAULT)}) AS module,
       count(DISTINCT client_id) AS lost_clients,
       CAST(sum(amount) AS DOUBLE) AS lost_amount
FROM per_key
WHERE ended > 0
  AND NOT coalesce(month_end AND restarted AND client_id IS NOT NULL AND product IS NOT NULL, false)
GROUP BY 1, 2
ORDER BY 1, 2
"""


def lost_by_module_month(contracts: DataFrame, clients: DataFrame, window: Window) -> DataFrame:
    """The flagship dataset through ``spark.sql`` (same result as the DataFrame plan)."""
    return run_sql(
        contracts.sparkSession,
        LOST_BY_MODULE_MONTH,
        {
            "lo": window.lo,
            "hi": window.hi,
            "next": shift_months(window.lo, 1),
            "until": last_of_month(shift_months(window.month0, 1)),
        },
        contracts=contracts,
        clients=clients,
    )
