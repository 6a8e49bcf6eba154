"""DuckDB definitions of the bound tables, mirrored from ``sources.bindings``."""

from __future__ import annotations

from lodestar import constants as C
from lodestar.functions.probability import ERFC_COEFFICIENTS
from lodestar.sources.bindings import EXPERIMENTS, HOLDOUT_START, NOW

NOW_SQL = f"TIMESTAMP '{NOW}'"
HOLDOUT_SQL = f"TIMESTAMP '{HOLDOUT_START}'"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def weight_sql(column: str = "event_type") -> str:
    cases = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in C.SIGNAL_WEIGHTS.items())
    return f"(CASE {column} {cases} END)"


def uniform_sql(text: str) -> str:
    """Twin of ``hash_uniform``; ``text`` is the ':'-joined key expression."""
    return f"(CAST('0x' || substr(sha256({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def hash_mod_sql(text: str, modulus: int) -> str:
    step = (1 << 32) % modulus
    acc = "0::BIGINT"
    for word in range(8):
        part = f"CAST('0x' || substr(sha256({text}), {word * 8 + 1}, 8) AS BIGINT)"
        acc = f"(({acc} * {step} + {part}) % {modulus})"
    return f"CAST({acc} AS INTEGER)"


def erfc_sql(z: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + ({z}) / 2.0::DOUBLE))"
    poly = f"{ERFC_COEFFICIENTS[-1]}::DOUBLE"
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"(({poly}) * {t} + ({coefficient}::DOUBLE))"
    return f"({t} * exp({poly} - ({z}) * ({z})))"


def freshness_sql(created: str, at: str = NOW_SQL) -> str:
    age = f"greatest((epoch_us({at}) - epoch_us({created})) / 1000000.0::DOUBLE / 3600.0::DOUBLE, 0)"
    return f"pow(0.5::DOUBLE, {age} / {C.FRESHNESS_HALF_LIFE_HOURS}::DOUBLE)"


IMPRESSION_SQL = f"event_type IN {sql_in(C.IMPRESSION_EVENTS)}"

_EXPERIMENT_ROWS = ", ".join(
    f"('{name}', {cl}, {ch}, {tl}, {th}, '{status}')" for name, cl, ch, tl, th, status in EXPERIMENTS
)

VIEWS: dict[str, str] = {
    "interactions": f"""
SELECT event_id, user_id, value,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item_id,
  CASE event_type
    WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'view_full' ELSE 'view_scroll_past' END
    WHEN 'click' THEN 'click'
    WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'share' ELSE 'save' END
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'dwell' ELSE 'skip' END
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'hide' ELSE 'report' END
  END AS event_type,
  CASE WHEN event_type = 'click' OR (event_type = 'signup' AND event_id % 2 = 0)
    THEN CAST(round(value * 1000) AS INTEGER) END AS dwell_ms,
  ts AS created_at,
  CASE WHEN event_id % 10 = 0 THEN NULL
    WHEN event_id % 97 = 0 THEN ts - INTERVAL 8 DAY
    ELSE ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS client_timestamp,
  list_extract({sql_list(C.DEVICES)}, user_id % 4 + 1) AS device,
  'key' || (user_id % 3) AS api_key,
  CASE WHEN event_id % 20 = 0 THEN 'canary' ELSE 'baseline' END AS model_version,
  value AS latency_ms
FROM events""",
    "event_replay": """
SELECT * FROM interactions
UNION ALL SELECT * REPLACE (created_at + INTERVAL 30 MINUTE AS created_at)
  FROM interactions WHERE event_id % 20 = 0
UNION ALL SELECT * REPLACE (created_at + INTERVAL 2 HOUR AS created_at)
  FROM interactions WHERE event_id % 20 = 1""",
    "items": f"""
SELECT e.vec_id AS item_id, list_extract({sql_list(C.CATEGORIES)}, e.label + 1) AS category,
  p.p_name AS content_text, CAST(e.embedding AS DOUBLE[]) AS embedding,
  {NOW_SQL} - to_hours(e.vec_id * 3) AS created_at
FROM embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id""",
    "unit_items": """
SELECT item_id, category, created_at, list_transform(embedding,
  lambda x: x / (sqrt(list_inner_product(embedding, embedding)) + 1e-9::DOUBLE)) AS vec
FROM items""",
    "users": f"""
SELECT e.user_id, min(e.ts) AS created_at,
  list_extract({sql_list(C.DEVICES)}, e.user_id % 4 + 1) AS device,
  [list_extract({sql_list(C.CATEGORIES)}, e.user_id % 10 + 1),
   list_extract({sql_list(C.CATEGORIES)}, (e.user_id * 7 + 3) % 10 + 1)] AS onboarding_categories
FROM events e WHERE e.user_id IN (SELECT c_custkey FROM customer)
GROUP BY e.user_id""",
    "purchases": """
SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS created_at, 'save' AS event_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "experiments": f"""
SELECT * FROM (VALUES {_EXPERIMENT_ROWS})
  t(name, control_low, control_high, treatment_low, treatment_high, status)""",
    "sequences": f"""
SELECT event_id, list_concat(list_transform(range({C.SEQUENCE_LENGTH} - len(s)), lambda x: 0), s) AS seq FROM (
  SELECT event_id, coalesce(list(item_id) OVER (PARTITION BY user_id ORDER BY created_at, event_id
    ROWS BETWEEN {C.SEQUENCE_LENGTH} PRECEDING AND 1 PRECEDING), []) AS s FROM interactions)""",
    "ctr_through": f"""
SELECT item_id, day, coalesce(sum(c) OVER w / nullif(sum(n) OVER w, 0)::DOUBLE, 0) AS ctr FROM (
  SELECT item_id, CAST(created_at AS DATE) AS day, count(*) FILTER (event_type = 'click') AS c,
    count(*) FILTER ({IMPRESSION_SQL}) AS n FROM interactions GROUP BY ALL)
WINDOW w AS (PARTITION BY item_id ORDER BY day)""",
    "impressions": f"""
SELECT user_id, CAST(created_at AS DATE) AS day, item_id,
  max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicked
FROM interactions WHERE {IMPRESSION_SQL}
GROUP BY user_id, CAST(created_at AS DATE), item_id""",
}
