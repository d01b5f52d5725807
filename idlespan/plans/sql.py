"""SQL pieces that the oracle queries share.  Times are nanoseconds, as in the adapter."""

from .adapter import SCALE, TOLERANCE

T = """t AS (SELECT event_id, user_id, event_type, event_type AS path, ts, epoch_us(ts) * 1000 AS start_ns,
  epoch_us(ts) * 1000 + CAST(round(value * 1e6) AS BIGINT) * 1000 AS end_ns, (k + 1) * 1048576 AS size,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 0 ELSE 1 END
  AS direction, k, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END AS pass
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

# Text endpoints and their parsed form.
TX = T + """, tx AS (SELECT *,
  CASE event_type WHEN 'click' THEN 'Host(NUMA ' || (user_id % 4) || ')' WHEN 'view' THEN 'NPU ' || (user_id % 8)
    WHEN 'purchase' THEN 'NPU ' || (user_id % 8) WHEN 'error' THEN 'Host(NUMA ' || (user_id % 4) || ')'
    ELSE 'Device ?' END AS source,
  CASE event_type WHEN 'view' THEN 'Host(NUMA ' || (user_id % 4) || ')'
    WHEN 'purchase' THEN 'NPU ' || ((user_id + 1) % 8) WHEN 'error' THEN 'Host(NUMA ' || ((user_id + 1) % 4) || ')'
    ELSE 'NPU ' || (user_id % 8) END AS destination,
  CASE event_type WHEN 'click' THEN 4294967295 WHEN 'error' THEN 4294967295 WHEN 'view' THEN user_id % 8
    WHEN 'purchase' THEN user_id % 8 ELSE 4294967294 END AS src_dev,
  CASE event_type WHEN 'view' THEN 4294967295 WHEN 'error' THEN 4294967295
    WHEN 'purchase' THEN (user_id + 1) % 8 ELSE user_id % 8 END AS dst_dev,
  CAST(CASE WHEN event_type IN ('click', 'error') THEN user_id % 4 ELSE 255 END AS INTEGER) AS src_numa,
  CAST(CASE event_type WHEN 'view' THEN user_id % 4 WHEN 'error' THEN (user_id + 1) % 4 ELSE 255 END AS INTEGER)
    AS dst_numa,
  CAST(CASE WHEN event_type = 'signup' THEN 2 ELSE 0 END AS INTEGER) AS flags FROM t)"""


def merged(src: str = "t", key: str = "path", tol: int = TOLERANCE, name: str = "busy") -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY start_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""{name}_a AS (SELECT *, max(end_ns) {over} 1 PRECEDING) AS pe FROM {src} WHERE end_ns >= start_ns),
{name}_b AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ns > pe + {tol} THEN 1 ELSE 0 END)
  {over} CURRENT ROW) AS run FROM {name}_a),
{name} AS (SELECT {key}, min(start_ns) AS start_ns, max(end_ns) AS end_ns, CAST(sum(size) AS BIGINT) AS bytes_total,
  count(*) AS event_count, count(*) > 1 AS merged FROM {name}_b GROUP BY {key}, run)"""


def gapped(key: str = "path", busy: str = "busy", name: str = "gaps") -> str:
    return f"""{name}_a AS (SELECT {key}, lag(end_ns) OVER (PARTITION BY {key} ORDER BY start_ns) AS g0, start_ns AS g1
  FROM {busy}),
{name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY g0) - 1 AS gap_idx, g0 AS start_ns,
  g1 AS end_ns, g1 - g0 AS duration_ns FROM {name}_a WHERE g1 > g0)"""


TB = f"{T}, {merged()}"
TBG = f"{TB}, {gapped()}"
TU = T.replace("event_type AS path", "CAST(user_id AS VARCHAR) AS path")
TUBG = f"{TU}, {merged()}, {gapped()}"


def with_(ctes: str, body: str) -> str:
    """A query on shared CTEs; a body that starts with a comma goes on with CTEs of its own."""
    return f"WITH {ctes}{body.lstrip()}" if body.lstrip().startswith(",") else f"WITH {ctes}\n{body}"


def values(name: str, column: str, items) -> str:
    """A CTE of literals."""
    return f"{name} AS (SELECT unnest([{', '.join(str(i) for i in items)}]) AS {column})"


HZ = values("hz", "horizon_ns", [f"CAST({h * SCALE} AS BIGINT)" for h in
                                 (10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_000_000)])

# Trailing survival as a prediction: share of the last 100 earlier gaps that reach the horizon.
PRED = f"""{HZ}, pred AS (SELECT path, gap_idx, start_ns, end_ns, duration_ns, horizon_ns, history,
  CASE WHEN history >= 10 THEN s ELSE 0 END AS p, CAST(duration_ns >= horizon_ns AS INTEGER) AS label FROM (
  SELECT *, count(*) OVER w AS history, avg(CASE WHEN duration_ns >= horizon_ns THEN CAST(1 AS DOUBLE) ELSE 0 END)
  OVER w AS s FROM gaps, hz WINDOW w AS (PARTITION BY path, horizon_ns ORDER BY gap_idx
  ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)))"""
TBGP = f"{TBG}, {PRED}"

CONFUSION = """count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (p < 0.5 AND label = 1) AS fn, count(*) FILTER (p < 0.5 AND label = 0) AS tn,
  avg((p - label) * (p - label)) AS brier, count(*) AS n"""
RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS false_safe_rate, round(brier, 6) AS brier"""


def edges(n: int = 10) -> str:
    """Bins of [0, 1] with the same binary edges as the library."""
    cuts = [i * (1.0 / n) for i in range(n)] + [1.0]
    rows = ", ".join(f"({i}, CAST('{cuts[i]!r}' AS DOUBLE), CAST('{cuts[i + 1]!r}' AS DOUBLE))" for i in range(n))
    return f"bins AS (SELECT * FROM (VALUES {rows}) v(bin, lower, upper))"
