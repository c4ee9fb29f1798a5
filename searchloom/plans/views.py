"""Input projections over the supplied tables (plain SQL that both engines run)."""

from statistics import NormalDist

from searchloom.plans.tables import view

# Search rows as exported text, dirtied by key so every parsing branch occurs.
view(
    "raw_search",
    """
SELECT l_orderkey AS row_id, l_linenumber AS line_no, l_partkey AS part_id,
  CASE l_orderkey % 9
    WHEN 0 THEN d WHEN 1 THEN replace(d, '-', '/') WHEN 2 THEN replace(d, '-', '.')
    WHEN 3 THEN substr(d, 6, 2) || '/' || substr(d, 9, 2) || '/' || substr(d, 1, 4)
    WHEN 4 THEN substr(d, 1, 4) || '年' || substr(d, 6, 2) || '月' || substr(d, 9, 2) || '日'
    WHEN 5 THEN ' ' || d || ' ' WHEN 6 THEN '' WHEN 7 THEN substr(d, 1, 4) || '-13-45' ELSE d END AS date_text,
  CASE l_partkey % 12
    WHEN 0 THEN '' WHEN 1 THEN '1,0' || lpad(q, 2, '0') WHEN 2 THEN ' ' || q || chr(160) WHEN 3 THEN 'n/a'
    WHEN 4 THEN '-' || q WHEN 5 THEN '~' WHEN 6 THEN 'inf' WHEN 7 THEN '-' WHEN 8 THEN q || '.5'
    WHEN 9 THEN q || 'e2' ELSE q END AS impressions_text,
  CASE WHEN l_suppkey % 17 = 0 THEN '9999' ELSE CAST(CAST(floor(l_quantity * l_discount) AS INT) AS STRING) END AS clicks_text,
  CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE CAST(CAST(round(l_tax * 100) AS INT) + 1 AS STRING) END AS position_text,
  CASE l_linenumber % 4 WHEN 0 THEN ' Nation_' || (l_suppkey % 25) WHEN 1 THEN 'NATION_' || (l_suppkey % 25)
    WHEN 2 THEN 'nation_' || (l_suppkey % 25) ELSE ' ' END AS country_text,
  CASE l_linestatus WHEN 'O' THEN 'Desktop' ELSE 'MOBILE ' END AS device_text,
  CASE l_partkey % 10
    WHEN 0 THEN 'HTTP://Shop.Example.com:80//part//' || l_partkey || '/?utm_source=ad&size=' || l_suppkey || '#spec'
    WHEN 1 THEN 'https://Shop.example.com:443/part/' || l_partkey || '/?size=' || l_suppkey || '&gclid=x1&b=2'
    WHEN 2 THEN '/part/' || l_partkey || '/'
    WHEN 3 THEN 'part/' || l_partkey || '?q=a'
    WHEN 4 THEN 'mailto:shop@example.com'
    WHEN 5 THEN ''
    WHEN 6 THEN '//cdn.example.com:8443/part/' || l_partkey
    WHEN 7 THEN '../up/./part/' || l_partkey
    WHEN 8 THEN '#top'
    ELSE 'https://shop.example.com/part/' || l_partkey || '?UTM_Medium=x&k=' END AS url_text
FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS STRING) AS d, CAST(CAST(l_quantity AS INT) AS STRING) AS q FROM lineitem) t
""",
)

# One row per property, day, page, query, country and device; a row without impressions has no position.
view(
    "search_daily",
    """
SELECT property_id, day, page, query, country, device, sum(clicks) AS clicks, sum(impressions) AS impressions,
  CASE WHEN min(part_id) % 7 = 0 OR sum(impressions) = 0 THEN NULL
    ELSE sum(pos_weight) / CASE WHEN sum(impressions) = 0 THEN 1.0E0 ELSE sum(impressions) END END AS position
FROM (
  SELECT 'property-' || n.n_regionkey AS property_id, CAST(l.l_shipdate AS DATE) AS day, l.l_partkey AS part_id,
    CASE WHEN l.l_partkey % 31 = 0 THEN '' ELSE '/part/' || (l.l_partkey % 200) END AS page,
    CASE WHEN l.l_suppkey % 13 = 0 THEN ' ' ELSE 'supplier ' || (l.l_suppkey % 40) END AS query,
    n.n_name AS country, l.l_linestatus AS device,
    CASE WHEN l.l_orderkey % 19 = 0 THEN 0.0E0 ELSE CAST(floor(l.l_quantity * l.l_discount) AS DOUBLE) END AS clicks,
    CASE WHEN l.l_orderkey % 19 = 0 THEN 0.0E0 ELSE l.l_quantity END AS impressions,
    CASE WHEN l.l_orderkey % 19 = 0 THEN 0.0E0 ELSE (round(l.l_tax * 100) + 1) * l.l_quantity END AS pos_weight
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
) t GROUP BY property_id, day, page, query, country, device
""",
)

# Two exports per property (one per customer) with declared collection facts.
view(
    "search_sources",
    """
SELECT 'property-' || c_custkey AS property_id, source_id,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Europe/Berlin' ELSE 'America/Los_Angeles' END AS embedded_timezone,
  CASE k % 11 WHEN 0 THEN 'Asia/Tokyo' WHEN 1 THEN 'America/Los_Angeles' ELSE NULL END AS outside_timezone,
  CASE k % 13 WHEN 0 THEN 'other_export' WHEN 1 THEN NULL ELSE 'gsc_search_analytics' END AS source_kind,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN window_end || 'T05:00:00Z' ELSE next_day || 'T18:30:00Z' END AS data_as_of,
  CASE WHEN k % 7 = 0 THEN 'unknown' WHEN k % 9 = 0 THEN 'preliminary' ELSE 'final' END AS finality,
  CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE k % 9 = 0 END AS preliminary,
  CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS row_limit_hit,
  CASE k % 12 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS pagination_complete,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' WHEN k % 14 = 0 THEN 'degraded' ELSE 'complete' END AS declared_quality
FROM (
  SELECT c_custkey, c_mktsegment, 'baseline' AS source_id, c_custkey AS k, '1997-12-31' AS window_end, '1998-01-01' AS next_day FROM customer
  UNION ALL
  SELECT c_custkey, c_mktsegment, 'current', c_custkey + 3, '1998-12-31', '1999-01-01' FROM customer
) t
""",
)
view(
    "properties",
    """
SELECT 'property-' || c_custkey AS property_id,
  CASE WHEN c_custkey % 23 = 0 THEN '' ELSE c_name END AS property_label,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'web' END AS search_type,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'Europe/Berlin' END AS analysis_timezone,
  c_custkey % 29 = 0 AS grain_overridden
FROM customer
""",
)
view(
    "ai_rows",
    """
SELECT property_id, day, page, country, device, sum(impressions) AS impressions
FROM search_daily GROUP BY property_id, day, page, country, device
""",
    needs=("search_daily",),
)
view(
    "ai_sources",
    """
SELECT c.c_custkey AS comparison_id, c.source_id,
  CASE WHEN (c.c_custkey + c.k) % 9 = 0 THEN NULL ELSE 'property-' || c.c_nationkey END AS property_id,
  CASE WHEN (c.c_custkey + c.k) % 7 = 0 THEN NULL WHEN c.c_custkey % 31 = 0 THEN 'set ' || c.k ELSE 'none' END AS filters,
  CASE (c.c_custkey + c.k) % 6 WHEN 0 THEN NULL WHEN 1 THEN c.window_end || 'T05:00:00Z' ELSE c.next_day || 'T18:30:00Z' END AS data_as_of,
  CASE (c.c_custkey + c.k) % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'preliminary' ELSE 'final' END AS finality,
  CASE (c.c_custkey + c.k) % 8 WHEN 1 THEN TRUE ELSE NULL END AS preliminary,
  CASE (c.c_custkey + c.k) % 10 WHEN 0 THEN 'unknown' WHEN 1 THEN 'incomplete' ELSE 'complete' END AS completeness,
  CASE (c.c_custkey + c.k) % 11 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS row_limit_hit,
  CAST(c.window_end AS DATE) AS window_end, coalesce(o.source_rows, 0) AS source_rows, coalesce(o.placeholder_rows, 0) AS placeholder_rows
FROM (
  SELECT c_custkey, c_nationkey, 'baseline' AS source_id, 0 AS k, '1997-12-31' AS window_end, '1998-01-01' AS next_day FROM customer
  UNION ALL
  SELECT c_custkey, c_nationkey, 'current', 4, '1998-12-31', '1999-01-01' FROM customer
) c
LEFT JOIN (SELECT o_custkey, count(*) AS source_rows,
    count(CASE WHEN o_orderkey % 40 = 0 THEN 1 END) AS placeholder_rows FROM orders GROUP BY o_custkey) o
  ON c.c_custkey = o.o_custkey
""",
)

# The three review sources in one table; a blank metric is NULL, never zero.
view(
    "review_rows",
    """
SELECT property_id, kind, day, landing_page, country, device, landing_page = '/part/11' AS explicitly_mapped,
  CASE WHEN property_id = 'property-4' AND kind = 'analytics' AND key_id % 2 = 0 THEN 'timestamp'
    WHEN day IS NULL THEN 'unknown' ELSE 'date' END AS temporal_grain,
  clicks, impressions, sessions, conversions, leads, qualified, pipeline_value
FROM (
  SELECT property_id, 'search' AS kind, day, landing_page, country, device, min(key_id) AS key_id,
    CASE WHEN min(key_id) % 97 = 0 THEN NULL ELSE sum(clicks) END AS clicks, sum(impressions) AS impressions,
    CAST(NULL AS DOUBLE) AS sessions, CAST(NULL AS DOUBLE) AS conversions, CAST(NULL AS DOUBLE) AS leads,
    CAST(NULL AS DOUBLE) AS qualified, CAST(NULL AS DOUBLE) AS pipeline_value
  FROM (SELECT 'property-' || n.n_regionkey AS property_id, l.l_orderkey AS key_id,
      CASE WHEN n.n_regionkey = 3 AND l.l_orderkey % 501 = 0 THEN NULL ELSE CAST(l.l_shipdate AS DATE) END AS day,
      CASE WHEN n.n_regionkey = 3 AND l.l_partkey % 53 = 0 THEN NULL ELSE '/part/' || (l.l_partkey % 50) END AS landing_page,
      n.n_name AS country, l.l_linestatus AS device, CAST(floor(l.l_quantity * l.l_discount) AS DOUBLE) AS clicks, l.l_quantity AS impressions
    FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey) a
  GROUP BY property_id, day, landing_page, country, device
  UNION ALL
  SELECT property_id, 'analytics', day, landing_page, country, device, min(o_orderkey), NULL, NULL, CAST(count(*) AS DOUBLE),
    CASE WHEN property_id <> 'property-1' AND min(o_orderkey) % 211 = 0 THEN NULL
      ELSE CAST(count(CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 1 END) AS DOUBLE) END, NULL, NULL, NULL
  FROM order_rows GROUP BY property_id, day, landing_page, country, device
  UNION ALL
  SELECT property_id, 'crm', day, landing_page, country, NULL, min(o_orderkey), NULL, NULL, NULL, NULL, CAST(count(*) AS DOUBLE),
    CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE), sum(floor(o_totalprice))
  FROM order_rows WHERE property_id <> 'property-2' OR day < DATE '1998-01-01' GROUP BY property_id, day, landing_page, country
) u
""",
    needs=("order_rows",),
)
view(
    "order_rows",
    """
SELECT o.*, 'property-' || n.n_regionkey AS property_id, CAST(o.o_orderdate AS DATE) AS day, '/part/' || (o.o_custkey % 50) AS landing_page,
  n.n_name AS country, CASE o.o_orderstatus WHEN 'P' THEN NULL ELSE o.o_orderstatus END AS device
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
""",
)
view(
    "review_sources",
    """
SELECT 'property-' || c_custkey AS property_id, kind, DATE '1998-12-31' AS window_end, 'UTC' AS analysis_timezone,
  CASE WHEN c_custkey < 3 THEN 'America/Los_Angeles' WHEN k % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Europe/Berlin'
    ELSE 'America/Los_Angeles' END AS source_timezone,
  CASE WHEN c_custkey % 11 = 4 THEN 'timestamp' WHEN k % 13 = 12 THEN 'unknown' ELSE 'date' END AS temporal_grain,
  CASE k % 6 WHEN 4 THEN NULL WHEN 5 THEN '1998-12-31T05:00:00Z' ELSE '1999-01-01T18:30:00Z' END AS data_as_of,
  CASE WHEN k % 9 = 7 THEN 'unknown' WHEN k % 9 = 8 THEN 'preliminary' ELSE 'final' END AS finality,
  CASE k % 8 WHEN 7 THEN TRUE WHEN 6 THEN FALSE ELSE NULL END AS preliminary,
  CASE k % 10 WHEN 8 THEN NULL WHEN 9 THEN TRUE ELSE FALSE END AS row_limit_hit,
  CASE k % 12 WHEN 10 THEN NULL WHEN 11 THEN FALSE ELSE TRUE END AS pagination_complete,
  CASE k % 5 WHEN 3 THEN NULL WHEN 4 THEN 0.5E0 ELSE 1.0E0 END AS sampling_rate,
  CASE k % 7 WHEN 5 THEN NULL WHEN 6 THEN TRUE ELSE FALSE END AS thresholding,
  CASE k % 11 WHEN 9 THEN NULL ELSE 'last_touch' END AS attribution_model,
  CASE k % 14 WHEN 12 THEN 'unknown' WHEN 13 THEN 'degraded' ELSE 'complete' END AS declared_quality
FROM (
  SELECT c_custkey, 'search' AS kind, c_custkey AS k FROM customer
  UNION ALL SELECT c_custkey, 'analytics', c_custkey + 1 FROM customer
  UNION ALL SELECT c_custkey, 'crm', c_custkey + 2 FROM customer WHERE c_custkey % 4 <> 3
  ) t WHERE kind = 'search' OR c_custkey % 10 <> 9
""",
)

# Five experiments over the event users: unit-days with text flags, repeats and gaps as they come.
view(
    "panel_rows",
    """
SELECT row_id, 'exp-' || (user_id % 5) AS experiment_id,
  CASE WHEN user_id % 29 = 3 AND day > DATE '2024-01-15' THEN 'late-' || user_id WHEN row_id % 307 = 5 THEN ' ' ELSE 'unit-' || user_id END AS unit_id,
  'pair-' || CAST(CAST(floor(user_id / 10) AS BIGINT) AS STRING) AS pair_id, day,
  CASE WHEN user_id % 50 = 49 AND row_id % 2 = 0 THEN 'maybe'
    WHEN (substr(sha256('g' || user_id), 1, 1) < '8') <> (user_id % 40 = 13 AND row_id % 2 = 0) THEN
      CASE row_id % 3 WHEN 0 THEN 'Treated' WHEN 1 THEN 'test' ELSE ' treatment ' END
    ELSE CASE row_id % 3 WHEN 0 THEN 'Holdout' WHEN 1 THEN 'control' ELSE '对照组' END END AS group_text,
  CASE WHEN row_id % 61 = 7 THEN '' WHEN row_id % 67 = 9 THEN '1,0' || lpad(CAST(clicks AS STRING), 2, '0') ELSE CAST(clicks AS STRING) END AS clicks,
  CAST(views AS STRING) AS views, CASE WHEN row_id % 173 = 2 THEN 'n/a' ELSE CAST(errors AS STRING) END AS errors,
  CASE WHEN row_id % 37 = 1 THEN 'YES' WHEN row_id % 83 = 1 THEN 'x' ELSE 'no' END AS contaminated_text,
  CASE WHEN row_id % 89 = 1 THEN '?' WHEN day > DATE '2024-01-15' AND substr(sha256('g' || user_id), 1, 1) < '8' THEN 'true' ELSE '0' END AS applied_text
FROM panel_base
""",
    needs=("panel_base",),
)
view(
    "panel_base",
    """
SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS row_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
  count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors
FROM events GROUP BY user_id, CAST(ts AS DATE), event_id % 101 = 0
""",
)
view(
    "baseline_rows",
    """
SELECT 'exp-' || (user_id % 5) AS experiment_id, 'unit-' || user_id AS unit_id,
  'pair-' || CAST(CAST(floor(user_id / 10) AS BIGINT) AS STRING) AS pair_id, day, CAST(sum(clicks) AS DOUBLE) AS clicks,
  CAST(sum(views) AS DOUBLE) AS views, CAST(sum(errors) AS DOUBLE) AS errors
FROM panel_base WHERE day <= DATE '2024-01-15' GROUP BY user_id, day
""",
    needs=("panel_base",),
)
view(
    "exp_specs",
    """
SELECT DISTINCT 'exp-' || (user_id % 5) AS experiment_id, CASE WHEN user_id % 5 >= 3 THEN 'matched_page_did' ELSE 'randomized_page_holdout' END AS design,
  'clicks' AS primary_metric, CASE user_id % 5 WHEN 1 THEN 'decrease' ELSE 'increase' END AS direction, 'seed-' || (user_id % 5) AS seed,
  CASE user_id % 5 WHEN 1 THEN 0.3E0 ELSE 0.5E0 END AS treatment_fraction,
  DATE '2024-01-01' AS baseline_start, DATE '2024-01-14' AS baseline_end, DATE '2024-01-16' AS observation_start, DATE '2024-01-30' AS observation_end,
  CASE user_id % 5 WHEN 2 THEN 0.5E0 ELSE 1.0E0 END AS mde_value, CASE user_id % 5 WHEN 2 THEN 'relative_to_control_baseline' ELSE 'absolute' END AS mde_scale,
  CASE user_id % 5 WHEN 4 THEN 0.1E0 ELSE 0.05E0 END AS alpha,
  CASE user_id % 5 WHEN 3 THEN FALSE WHEN 4 THEN NULL ELSE TRUE END AS artifact_passed,
  CASE user_id % 5 WHEN 0 THEN '2024-01-31' WHEN 1 THEN '2024-01-31T09:00:00Z' WHEN 2 THEN '2024-01-31T03:00:00Z' WHEN 3 THEN '2024-01-29' ELSE '2024-03-01T00:00:00Z' END AS data_as_of,
  CASE user_id % 5 WHEN 4 THEN 'Asia/Tokyo' ELSE 'America/Los_Angeles' END AS source_timezone,
  CASE user_id % 5 WHEN 3 THEN DATE '2024-01-30' ELSE DATE '2024-02-02' END AS analysis_as_of, '2024-02-02 12:00:00' AS now_utc
FROM events
""",
)
view(
    "guardrails",
    """
SELECT DISTINCT 'exp-' || (user_id % 5) AS experiment_id, 'views' AS metric, 'non_decrease' AS direction, 0.25E0 AS threshold FROM events
UNION ALL SELECT DISTINCT 'exp-' || (user_id % 5), 'errors', 'non_increase', 0.1E0 FROM events
""",
)
# One specification per customer, with every kind of fault.
view(
    "draft_specs",
    """
SELECT CASE WHEN c_custkey % 41 = 1 THEN ' ' ELSE 'draft-' || c_custkey END AS experiment_id,
  CASE c_custkey % 7 WHEN 0 THEN 'before_after' WHEN 1 THEN 'matched_page_did' ELSE 'randomized_page_holdout' END AS design,
  'clicks' AS primary_metric, CASE c_custkey % 13 WHEN 0 THEN 'up' ELSE 'increase' END AS direction,
  CASE c_custkey % 17 WHEN 0 THEN '' ELSE 's' || c_custkey END AS seed,
  CASE c_custkey % 5 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.3E0 ELSE 0.5E0 END AS treatment_fraction,
  DATE '2024-01-01' AS baseline_start, CASE c_custkey % 11 WHEN 0 THEN DATE '2023-12-01' WHEN 1 THEN DATE '2024-02-20' ELSE DATE '2024-01-31' END AS baseline_end,
  DATE '2024-02-10' AS observation_start, CASE c_custkey % 19 WHEN 0 THEN DATE '2024-02-01' ELSE DATE '2024-03-01' END AS observation_end,
  CASE c_custkey % 8 WHEN 0 THEN 0.0E0 WHEN 1 THEN NULL ELSE 1.5E0 END AS mde_value, CASE c_custkey % 9 WHEN 0 THEN 'percent' ELSE 'absolute' END AS mde_scale,
  CASE c_custkey % 10 WHEN 0 THEN 1.0E0 ELSE 0.05E0 END AS alpha, CASE c_custkey % 6 WHEN 0 THEN 'ranking_factor' WHEN 1 THEN 'none' ELSE NULL END AS paid_role,
  CASE c_custkey % 12 WHEN 0 THEN 'clicks' ELSE 'views' END AS rail_1, CASE c_custkey % 14 WHEN 0 THEN 'views' ELSE 'errors' END AS rail_2,
  CASE c_custkey % 15 WHEN 0 THEN 'flat' ELSE 'non_decrease' END AS rail_direction, CASE c_custkey % 16 WHEN 0 THEN -1.0E0 ELSE 0.1E0 END AS rail_threshold
FROM customer
""",
)
view(
    "frozen_sources",
    """
SELECT 'exp-' || c_custkey AS experiment_id, source_id, CASE source_id WHEN 'web' THEN 'ga4_property_report' ELSE 'crm_aggregate_export' END AS source_kind,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 8 = 0 THEN 'Europe/Berlin' ELSE 'America/Los_Angeles' END AS source_timezone,
  CASE source_id WHEN 'web' THEN CASE WHEN k % 5 = 0 THEN 'clicks' ELSE 'clicks,views' END ELSE CASE WHEN k % 6 = 0 THEN 'leads,views' WHEN k % 7 = 0 THEN 'leads,spam' ELSE 'leads' END END AS metrics,
  CASE WHEN k % 10 = 0 THEN NULL ELSE 'last_touch' END AS attribution_model, CAST(NULL AS STRING) AS data_as_of, 'unknown' AS finality,
  CAST(NULL AS BOOLEAN) AS preliminary, CAST(NULL AS BOOLEAN) AS row_limit_hit, CAST(NULL AS BOOLEAN) AS pagination_complete,
  CAST(NULL AS DOUBLE) AS sampling_rate, CAST(NULL AS BOOLEAN) AS thresholding, 'complete' AS declared_quality
FROM (SELECT c_custkey, 'web' AS source_id, c_custkey AS k FROM customer UNION ALL SELECT c_custkey, 'deals', c_custkey + 1 FROM customer) t
""",
)
view(
    "supplied_sources",
    """
SELECT 'exp-' || c_custkey AS experiment_id, source_id, CASE WHEN k % 23 = 0 THEN 'other_kind' ELSE NULL END AS source_kind,
  CASE WHEN k % 21 = 0 THEN 'UTC' ELSE NULL END AS source_timezone, CASE WHEN k % 19 = 0 THEN 'clicks' ELSE NULL END AS metrics,
  CASE WHEN k % 17 = 0 THEN 'first_touch' ELSE NULL END AS attribution_model,
  CASE WHEN k % 11 = 0 THEN NULL ELSE '2024-02-01T00:00:00Z' END AS data_as_of, CASE WHEN k % 12 = 0 THEN 'preliminary' WHEN k % 13 = 0 THEN NULL ELSE 'final' END AS finality,
  CASE WHEN k % 14 = 0 THEN TRUE ELSE NULL END AS preliminary, CASE WHEN k % 15 = 0 THEN TRUE WHEN k % 16 = 0 THEN NULL ELSE FALSE END AS row_limit_hit,
  k % 18 <> 0 AS pagination_complete, CASE WHEN k % 20 = 0 THEN NULL WHEN k % 22 = 0 THEN 0.2E0 ELSE 1.0E0 END AS sampling_rate,
  CASE WHEN k % 24 = 0 THEN NULL ELSE k % 25 = 0 END AS thresholding, CASE WHEN k % 26 = 0 THEN 'degraded' ELSE NULL END AS declared_quality
FROM (SELECT c_custkey, 'web' AS source_id, c_custkey AS k FROM customer UNION ALL SELECT c_custkey, 'deals', c_custkey + 1 FROM customer
  UNION ALL SELECT c_custkey, 'late', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') t
""",
)

GENESIS = "0" * 64
_N = NormalDist()
# Power of an effect of 2.802 standard errors at alpha 0.05, as evidence would state it.
_POWER_2802 = repr(round(_N.cdf(-_N.inv_cdf(0.975) - 2.802) + 1 - _N.cdf(_N.inv_cdf(0.975) - 2.802), 12)) + "E0"
CHAIN = 8  # records per chain: eight consecutive events, so building one never gathers more


def _chained() -> str:
    """Hash each chain record over its predecessor's hash, one nesting level per position."""
    fields = ", ".join(
        f"max(CASE WHEN sequence = {i} THEN {c} END) AS {c}{i}" for i in range(1, CHAIN + 1) for c in ("head", "tail")
)
    inner = f"(SELECT project_id, chain, {fields} FROM ledger_base GROUP BY project_id, chain) c0"
    for i in range(1, CHAIN + 1):
        prev = f"'{GENESIS}'" if i == 1 else f"h{i - 1}"
        inner = f"(SELECT *, sha256(head{i} || {prev} || tail{i}) AS h{i} FROM {inner}) c{i}"
    pick = lambda shift: " ".join(
        f"WHEN {i} THEN {(f'h{i - shift}' if i - shift > 0 else repr(GENESIS))}" for i in range(1, CHAIN + 1)
)
    return f"""
SELECT b.project_id, b.chain, b.sequence, b.event_id, b.head, b.tail,
  CASE b.sequence {pick(1)} END AS previous_hash, CASE b.sequence {pick(0)} END AS record_hash
FROM ledger_base b JOIN {inner} ON b.project_id = c{CHAIN}.project_id AND b.chain = c{CHAIN}.chain
"""


view(
    "ledger_base",
    """
SELECT project_id, chain, sequence, event_id, '{"change_id":"change-' || user_id || '","previous_hash":"' AS head,
  '","project_sha256":"' || CASE WHEN event_id % 127 = 3 THEN sha256('other') ELSE sha256(project_id) END || '","record_kind":"' || chain
  || '","schema_version":"1.0","sequence":' || sequence || ',"status":"' || event_type || '"}' AS tail
FROM (SELECT *, 'project-' || CAST(CAST(floor(event_id / 16) AS BIGINT) AS STRING) AS project_id,
  CASE WHEN floor(event_id / 8) % 2 = 0 THEN 'change' ELSE 'review' END AS chain, CAST(event_id % 8 + 1 AS BIGINT) AS sequence FROM events) e
""",
)
view("ledger_clean", _chained(), needs=("ledger_base",))
# Lines as stored, some tampered with after hashing.
view(
    "ledger_lines",
    """
SELECT project_id, chain, sequence AS line_number, CASE
    WHEN event_id % 101 = 4 THEN replace(full_line, '"status":"', '"status":"edited-')
    WHEN event_id % 151 = 5 THEN replace(full_line, previous_hash, sha256('elsewhere'))
    WHEN event_id % 173 = 6 THEN replace(full_line, '"sequence":', '"sequence":1')
    WHEN event_id % 199 = 7 THEN '[1]' WHEN event_id % 211 = 8 THEN '' ELSE full_line END AS line
FROM (SELECT *, replace(head || previous_hash || tail, '","record_kind"', '","record_hash":"' || record_hash || '","record_kind"') AS full_line FROM ledger_clean) l
""",
    needs=("ledger_clean",),
)
view(
    "ledger_heads",
    """
SELECT a.project_id, a.chain, a.sequence, CASE WHEN a.event_id % 31 = 2 THEN sha256('missing') WHEN a.sequence = 1 THEN '"""
    + GENESIS
    + """' ELSE b.record_hash END AS other_head
FROM ledger_clean a JOIN ledger_clean b ON a.project_id = b.project_id AND a.sequence = b.sequence AND a.chain <> b.chain
""",
    needs=("ledger_clean",),
)
# Status history of changes: one change per event user, in event order.
view(
    "change_events",
    """
SELECT 'project-' || (user_id % 3) AS project_id, 'change-' || user_id AS change_id, event_id AS sequence,
  CASE event_type WHEN 'view' THEN 'planned' WHEN 'click' THEN 'implemented' WHEN 'signup' THEN 'artifact_verified'
    WHEN 'purchase' THEN 'outcome_pending' ELSE CASE event_id % 5 WHEN 0 THEN 'implementation_failed' WHEN 1 THEN 'rolled_back' WHEN 2 THEN 'cancelled'
      WHEN 3 THEN 'reviewed' ELSE 'shipped' END END AS status,
  CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS passed, CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'evidence-' || event_id END AS evidence,
  CASE WHEN event_id % 6 < 3 THEN 'exp-' || user_id ELSE NULL END AS registered_experiment
FROM events
""",
)
view(
    "reviews",
    """
SELECT 'project-' || (conv_id % 3) AS project_id, 'review-' || conv_id || '-' || (turn % 4) AS review_id, 'change-' || (conv_id % 170) AS change_id,
  conv_id * 1000 + turn AS sequence, CASE (conv_id + turn) % 8 WHEN 0 THEN 'implementation-failed' WHEN 1 THEN 'incremental-positive' WHEN 2 THEN 'no-detectable-change'
    WHEN 3 THEN 'incremental-positive' WHEN 4 THEN 'no-detectable-change' WHEN 5 THEN 'directional-positive' WHEN 6 THEN 'won' ELSE 'inconclusive' END AS verdict,
  CASE WHEN conv_id % 9 = 0 THEN NULL ELSE 'exp-' || (conv_id % 170) END AS experiment_id, CASE WHEN turn % 5 = 4 THEN NULL ELSE 'holdout' END AS counterfactual_method,
  CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 3 = 0 THEN 2.801E0 ELSE 2.802E0 END AS preregistered_mde,
  CASE WHEN conv_id % 13 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN 0.5E0 WHEN conv_id % 5 = 0 THEN 0.799719913309E0 ELSE """ + _POWER_2802 + """ END AS claimed_power,
  CASE WHEN conv_id % 10 = 0 THEN 'limited' ELSE 'complete' END AS integrity_status, CASE WHEN conv_id % 12 = 0 THEN 1 ELSE 0 END AS integrity_issues,
  CASE WHEN conv_id % 14 = 0 THEN ' ' ELSE 'result.json' END AS integrity_evidence, turn % 3 = 0 AS passed, CASE WHEN turn % 2 = 0 THEN 'log' ELSE NULL END AS evidence
FROM conversations
""",
)
view(
    "results",
    """
SELECT 'exp-' || c_custkey AS experiment_id, CASE WHEN c_custkey % 16 = 0 THEN 'inconclusive' ELSE 'eligible_incremental' END AS eligibility,
  c_custkey % 15 <> 0 AS artifact_passed, c_custkey % 17 <> 0 AS quality_passed, CASE WHEN c_custkey % 18 = 0 THEN 'inconclusive' ELSE 'complete' END AS measurement_status,
  c_custkey % 5 <> 0 AS point_supports, c_custkey % 4 <> 0 AS interval_supports, CASE WHEN c_custkey % 6 = 0 THEN 2.801E0 ELSE 2.802E0 END AS mde,
  CASE WHEN c_custkey % 8 = 0 THEN 2.0E0 ELSE 1.0E0 END AS standard_error, 0.05E0 AS alpha, CASE WHEN c_custkey % 2 = 0 THEN -1.0E0 ELSE 0.5E0 END AS ci_lower, 2.0E0 AS ci_upper
FROM customer
""",
)

# Crawled pages, the last capture of each URL; then the same with injected head and body tags, so every
# page rule has hits and misses.
view(
    "page_base",
    """
SELECT p.page_id, regexp_replace(p.url, '#.*$', '') AS url, p.html, regexp_extract(p.url, '^[a-z]+://[^/]+', 0) AS site_id
FROM pages p JOIN (SELECT max(page_id) AS page_id FROM pages GROUP BY regexp_replace(url, '#.*$', '')) k ON p.page_id = k.page_id
""",
)
view("page_hub", "SELECT site_id, min(page_id) AS hub_id FROM page_base GROUP BY site_id", needs=("page_base",))
view(
    "page_linked",
    """
SELECT b.page_id AS p, b.site_id, b.url, b.html, h.url AS hub_url, coalesce(n.url, b.url) AS next_url, coalesce(r.url, b.url) AS prev_url,
  coalesce(q.url, b.url) AS requested_url
FROM page_base b JOIN page_hub g ON b.site_id = g.site_id JOIN page_base h ON h.page_id = g.hub_id
LEFT JOIN page_base n ON n.page_id = b.page_id + 1 LEFT JOIN page_base r ON r.page_id = b.page_id - 1
LEFT JOIN page_base q ON q.page_id = b.page_id - CASE b.page_id % 13 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END
""",
    needs=("page_base", "page_hub"),
)
view(
    "site_pages",
    """
SELECT p AS page_id, site_id, url, requested_url, url AS final_url, CASE p % 13 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS redirect_hops,
  CASE p % 11 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN NULL WHEN 3 THEN 301 ELSE 200 END AS status,
  CASE p % 17 WHEN 0 THEN 'otherbot: noindex' WHEN 1 THEN 'googlebot: noindex, max-snippet: 5' ELSE '' END AS x_robots,
  replace(shaped, '</head>',
    CASE WHEN p % 4 <> 0 THEN '<link rel="canonical" href="' || url || '">' ELSE '' END
    || CASE WHEN p % 16 IN (1, 4) THEN '<link rel="canonical" href="' || next_url || '">' WHEN p % 16 = 8 THEN '<link rel="canonical" href="ftp://files.example.com/x">' ELSE '' END
    || CASE WHEN p % 14 = 7 THEN '<meta name="googlebot" content="none">' WHEN p % 7 = 0 THEN '<meta name="robots" content="NOINDEX, follow">'
       WHEN p % 7 = 1 THEN '<meta name="robots" content="max-snippet:5; index">' ELSE '' END
    || CASE WHEN p % 5 = 0 THEN '<link rel="alternate" hreflang="en" href="' || url || '"><link rel="alternate" hreflang="fr" href="' || next_url || '"><link rel="alternate" hreflang="x-default" href="' || hub_url || '">'
       WHEN p % 5 = 1 AND p % 25 <> 1 THEN '<link rel="alternate" hreflang="fr" href="' || url || '"><link rel="alternate" hreflang="en" href="' || prev_url || '">'
       WHEN p % 10 = 3 THEN '<link rel="alternate" hreflang="de" href="' || url || '"><link rel="alternate" hreflang="DE" href="' || hub_url || '">'
       WHEN p % 10 = 8 THEN '<link rel="alternate" hreflang="es" href="' || hub_url || '">' ELSE '' END
    || CASE WHEN p % 18 = 3 THEN '<script type="application/ld+json">{"@type":"Product",}</script>'
       WHEN p % 6 = 0 THEN '<script type="application/ld+json">{"@type":"WebSite","publisher":{"@type":["Brand","Organization"]}}</script>' ELSE '' END
    || CASE WHEN p % 3 <> 0 THEN '<meta name="Description" content=" Text  ' || (p % 4) || ' ">' ELSE '' END
    || CASE WHEN p % 30 = 2 THEN '<title>Second</title>' ELSE '' END || '</head>')
  || '<a href="' || hub_url || '">Hub page</a><a href="' || next_url || '" rel="nofollow Sponsored">Next</a><a href="mailto:a@example.com">Mail</a><a href="#top">Top</a>'
  || CASE WHEN p % 4 = 0 THEN '<a href="/missing?x=1&amp;utm_campaign=z#f">Filter</a>' ELSE '' END
  || CASE WHEN p % 12 = 0 THEN '<a>no target</a>' WHEN p % 12 = 6 THEN '<span role="link">x</span>' ELSE '' END
  || '<img src="/img/ok.png" alt="">' || CASE WHEN p % 9 = 0 THEN '<img src="/img/' || p || '.png">' ELSE '' END
  || CASE WHEN p % 8 = 0 THEN '<picture><source srcset="/img/a.webp 1x, /img/b.webp 2x"><img src="https://cdn.example.com/c.png" alt="c" width="10" height="5"></picture>' ELSE '' END
  || CASE WHEN p % 10 = 0 THEN '<img data-src="/img/lazy.png" alt="lazy">' ELSE '' END AS html
FROM (
  SELECT *, CASE WHEN p % 40 = 3 THEN replace(replace(titled, '<h1>', '<h2>'), '</h1>', '</h2>') WHEN p % 20 = 0 THEN replace(titled, '<html lang="', '<html data-lang="') ELSE titled END AS shaped
  FROM (SELECT *, CASE WHEN p % 30 = 4 THEN regexp_replace(html, '<title>[^<]*</title>', '') ELSE html END AS titled FROM page_linked) t
) s
""",
    needs=("page_linked",),
)
# The same pages after client-side scripts ran.
view(
    "rendered_pages",
    """
SELECT page_id, site_id, url, requested_url, final_url, redirect_hops, status, x_robots,
  CASE page_id % 6 WHEN 1 THEN html || '<a href="/client">Client link</a>' WHEN 2 THEN replace(html, '<link rel="canonical"', '<link rel="was-canonical"')
    WHEN 3 THEN replace(replace(html, '"NOINDEX, follow"', '"follow"'), '"none"', '"all"') ELSE html END AS html
FROM site_pages WHERE page_id % 15 <> 14
UNION ALL
SELECT page_id, site_id, site_id || '/only-rendered/' || page_id, url, url, 0, status, '', html FROM site_pages WHERE page_id % 15 = 14
""",
    needs=("site_pages",),
)
view("sites", "SELECT DISTINCT site_id, length(site_id) % 2 = 0 AS production FROM page_base UNION ALL SELECT DISTINCT 'https://' || lower(n_name) || '.example.com', TRUE FROM nation", needs=("page_base",))
view("fetches", "SELECT site_id, url, status FROM site_pages", needs=("site_pages",))
view(
    "assets",
    "SELECT DISTINCT site_id, site_id || '/img/ok.png' AS url FROM page_base UNION ALL SELECT DISTINCT site_id, site_id || '/img/a.webp' FROM page_base",
    needs=("page_base",),
)
view(
    "redirects",
    """
SELECT b.url, t.url AS location FROM page_base b JOIN page_base t
  ON t.page_id = CASE WHEN b.page_id % 26 = 6 THEN b.page_id - 1 ELSE b.page_id + 1 END
WHERE b.page_id % 13 IN (0, 1) OR b.page_id % 26 IN (5, 6) OR b.page_id % 40 BETWEEN 20 AND 33
""",
    needs=("page_base",),
)
# Sitemap files of at most fifty locations, an index per fifty files, and a root index naming those.
view(
    "sitemap_docs",
    """
SELECT site_id, doc_url, CASE WHEN (length(doc_url) + k) % 9 = 4 THEN '<urlset><url><loc>' || site_id || '</url>' WHEN (length(doc_url) + k) % 9 = 5 THEN '<feed><entry/></feed>'
  ELSE '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || body || '<url><loc> ' || site_id || '/ghost/' || k || ' </loc></url><url><loc>https://elsewhere.example.org/x</loc></url><url><loc>not-absolute</loc></url>'
    || '<url><loc>' || site_id || '//ghost/' || k || '#again</loc></url></urlset>' END AS xml
FROM (SELECT site_id, site_id || '/sitemap-' || k || '.xml' AS doc_url, k, string_agg('<url><loc>' || replace(url, '&', '&amp;') || '</loc><priority>0.5</priority></url>', '') AS body
  FROM (SELECT *, CAST(floor(page_id / 50) AS BIGINT) AS k FROM page_base) b GROUP BY site_id, k) d
UNION ALL
SELECT site_id, site_id || '/index-' || m || '.xml', '<sitemapindex>' || string_agg('<sitemap><loc>/sitemap-' || k || '.xml</loc></sitemap>', '') || '<sitemap><loc>https://elsewhere.example.org/s.xml</loc></sitemap></sitemapindex>'
FROM (SELECT DISTINCT site_id, CAST(floor(page_id / 50) AS BIGINT) AS k, CAST(floor(page_id / 2500) AS BIGINT) AS m FROM page_base) e GROUP BY site_id, m
UNION ALL
SELECT site_id, site_id || '/sitemap.xml', '<sitemapindex>' || string_agg('<sitemap><loc>index-' || m || '.xml</loc></sitemap>', '') || '</sitemapindex>'
FROM (SELECT DISTINCT site_id, CAST(floor(page_id / 2500) AS BIGINT) AS m FROM page_base) f GROUP BY site_id
""",
    needs=("page_base",),
)
view(
    "robots_docs",
    """
SELECT site_id, CASE length(site_id) % 5
  WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'Allow: /en/' || chr(10) || 'Disallow: /en/1' || chr(10)
  WHEN 1 THEN '# note' || chr(10) || 'Disallow: /fr/' || chr(10) || 'User-agent: Googlebot' || chr(10) || 'User-agent: otherbot' || chr(10) || 'Disallow: /*page=*' || chr(10) || 'Allow: /en/*page' || chr(10) || 'Noindex: /old' || chr(10)
  WHEN 2 THEN 'User-agent: google' || chr(10) || 'Disallow: /*.html$' || chr(10) || 'Sitemap: ' || site_id || '/sitemap.xml' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10)
  WHEN 3 THEN 'USER-AGENT: *' || chr(13) || chr(10) || 'Disallow:' || chr(13) || chr(10) || 'Disallow: /fr # french' || chr(13) || chr(10) || 'Allow: /fr' || chr(10)
  ELSE 'User-agent: otherbot' || chr(10) || 'Disallow: /' || chr(10) END AS text
FROM (SELECT DISTINCT site_id FROM page_base) s
""",
    needs=("page_base",),
)
view(
    "graph_edges",
    """
SELECT 'site-' || (l_suppkey % 3) AS site_id, 'p' || (l_partkey % 1000) AS source, 'p' || (((l_partkey % 1000) * 2 + l_linenumber % 2) % 1000) AS target FROM lineitem
""",
)

# Responses and prompts.
view(
    "json_responses",
    """
SELECT conv_id, turn, '{"conv":{"id":' || conv_id || ',"role":"' || role || '"},"files":[{"path":"a' || turn || '.md"}],"facts":["f' || (conv_id % 3) || '","f' || (turn % 4) || '","g"]}' AS response,
  CASE (conv_id + turn) % 6 WHEN 0 THEN 'conv.id' WHEN 1 THEN 'conv.role' WHEN 2 THEN 'files.0.path' WHEN 3 THEN 'conv.absent' WHEN 4 THEN 'files.9.path' ELSE 'facts' END AS target,
  CASE (conv_id + turn) % 6 WHEN 0 THEN CAST(conv_id AS STRING) WHEN 1 THEN '"user"' WHEN 2 THEN '"a1.md"' ELSE '[ "f0", "f1", "g" ]' END AS expected
FROM conversations
""",
)
view(
    "prompts",
    """
SELECT text_id, text FROM all_texts
UNION ALL SELECT 'prompt-' || o_orderkey, CASE o_orderkey % 24
  WHEN 0 THEN '帮我创建一个 SEO skill' WHEN 1 THEN 'Build a generic  SKILL for invoices' WHEN 2 THEN 'campaign 预算 怎么设' WHEN 3 THEN '什么是 SEO' WHEN 4 THEN '什么是 SEO，我的网站要吗'
  WHEN 5 THEN '写一个 content brief' WHEN 6 THEN '上月自然搜索流量下降了很多' WHEN 7 THEN '没有明显的流量下降，继续上次' WHEN 8 THEN '给我 90 天路线图' WHEN 9 THEN '这次改动效果复盘，GSC 点击数据已导出'
  WHEN 10 THEN '检查内链和孤儿页' WHEN 11 THEN '重写这篇 seo 文章' WHEN 12 THEN '搜索词报告 用于 SEO 出价' WHEN 13 THEN '帮我修 title' WHEN 14 THEN 'please audit https://example.com/' || o_custkey
  WHEN 15 THEN 'see HTTP://example.com/x' WHEN 16 THEN 'organic traffic has dropped since May' WHEN 17 THEN 'no organic traffic drop was observed' WHEN 18 THEN 'how to avoid a traffic drop' WHEN 19 THEN 'if rankings decline recently'
  WHEN 20 THEN '近期索引覆盖异常' WHEN 21 THEN 'deindexed pages, clicks fell' WHEN 22 THEN '为什么 keyword ' || o_custkey ELSE 'order ' || o_orderkey END FROM orders
""",
    needs=("all_texts",),
)
view(
    "project_files",
    """
SELECT 'project-' || (o_custkey % 97) AS project_id, o_orderkey AS file_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'GSC export, clicks are available' WHEN 1 THEN '新版已经上线' WHEN 2 THEN 'crm revenue next year' ELSE 'plain project' END AS project_text,
  CASE o_orderkey % 9 WHEN 0 THEN 'gsc.csv' WHEN 1 THEN 'export-ga4-2024.csv' WHEN 2 THEN 'holdout plan.md' WHEN 3 THEN 'changelog.md' ELSE 'notes' || o_orderkey || '.txt' END AS name,
  'text/csv' AS type, CASE o_orderkey % 11 WHEN 0 THEN 'page, clicks, impressions' WHEN 1 THEN 'Google Analytics sessions and conversions' WHEN 2 THEN 'crm leads' WHEN 3 THEN '合格线索 12'
    WHEN 4 THEN 'We deployed it' WHEN 5 THEN ' ' WHEN 6 THEN 'experiment result window' ELSE 'order ' || o_orderkey END AS content,
  CASE o_orderkey % 13 WHEN 0 THEN 0 ELSE 100 END AS size
FROM orders
UNION ALL SELECT 'project-' || doc_id % 97, 1000000000 + doc_id, source, 'document ' || lang, 'text/plain', text, n_chars FROM documents
""",
)
view(
    "claim_sources",
    """
SELECT item_id AS source_id, CASE item_id % 7 WHEN 0 THEN 'provided_data' WHEN 1 THEN 'memory' ELSE 'public_web' END AS source_type,
  CASE item_id % 5 WHEN 0 THEN 'file:data.csv' WHEN 1 THEN 'nowhere' ELSE 'https://example.org/' || item_id END AS locator,
  CASE item_id % 6 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS http_status, CASE item_id % 8 WHEN 0 THEN 'pending' ELSE 'captured' END AS snapshot_status,
  CASE item_id % 9 WHEN 0 THEN 'too short' ELSE text END AS snapshot_excerpt FROM benchmark
""",
)
view(
    "claims",
    """
SELECT 'claim-' || d.doc_id AS claim_id, d.source AS case_key, d.doc_id % 61 AS source_id, d.doc_id % 4 = 0 AS is_numeric,
  'Doc ' || d.doc_id || '  states: ' || d.text AS claim_text,
  CASE d.doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'something else entirely' ELSE 'doc ' || d.doc_id || ' STATES' END AS supported_claim,
  CASE d.doc_id % 10 WHEN 0 THEN NULL WHEN 3 THEN 'short' WHEN 4 THEN 'an excerpt that is nowhere' ELSE substr(b.text, 4, 40) END AS supporting_excerpt
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 61
""",
)
view(
    "work_reports",
    """
SELECT o_orderkey, 'a.md' AS p1, 'x' || (o_custkey % 3) AS b1, 'x' || (o_custkey % 2) AS a1, CASE o_orderkey % 5 WHEN 0 THEN '../b.md' WHEN 1 THEN '/etc/b.md' ELSE 'docs/b.md' END AS p2, 'y' AS b2, 'y' AS a2,
  o_orderkey % 3 AS exit_1, o_orderkey % 2 AS exit_2, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'v1' ELSE 'v1,v0' END AS before_log,
  CASE o_orderkey % 6 WHEN 0 THEN 'v2,v1,v0' WHEN 1 THEN 'v2,v1' WHEN 2 THEN 'v1,v0' WHEN 3 THEN 'v3,v2,v1,v0' WHEN 4 THEN 'v9' ELSE 'v1,v0,v2' END AS after_log
FROM orders
""",
)

# Planning inputs.
view(
    "vital_samples",
    """
SELECT 'u' || (user_id % 60) AS url, CASE WHEN event_type IN ('view', 'click') THEN 'PHONE' ELSE 'DESKTOP' END AS device,
  CASE event_id % 3 WHEN 0 THEN 'LCP' WHEN 1 THEN 'INP' ELSE 'CLS' END AS metric,
  CASE event_id % 3 WHEN 0 THEN value / 4 WHEN 1 THEN value * 20 ELSE value / 80 END AS value FROM events
""",
)
view(
    "order_cohorts",
    """
SELECT substr(CAST(o_orderdate AS STRING), 1, 7) AS cohort, o_orderpriority AS cluster, CAST(count(*) AS DOUBLE) AS sessions,
  CAST(count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS DOUBLE) AS qualified, CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) AS opportunities,
  CAST(count(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 50000 THEN 1 END) AS DOUBLE) AS matured,
  CAST(count(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 1 END) AS DOUBLE) AS won,
  sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) ELSE 0 END) * 1.0E0 AS revenue,
  sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 4) ELSE 0 END) * 1.0E0 AS margin, CAST(count(*) * 5000 AS DOUBLE) AS cost
FROM orders GROUP BY substr(CAST(o_orderdate AS STRING), 1, 7), o_orderpriority
""",
)
view(
    "stage_days",
    """
SELECT substr(CAST(o_orderdate AS STRING), 1, 7) AS cohort, o_orderpriority AS cluster, CAST(l_linenumber * 7 + l_partkey % 40 AS DOUBLE) AS days
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""",
)
view(
    "markets",
    """
SELECT n_name AS market, CAST(count(*) * 300 AS DOUBLE) AS cost, CAST(count(*) * 7 AS DOUBLE) AS clicks,
  CAST(count(CASE WHEN o_totalprice > 150000 THEN 1 END) AS DOUBLE) AS deals, CAST(100 + n_nationkey * 20 AS DOUBLE) AS value_per_deal
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey
""",
)
view("backlinks", "SELECT 'd' || (l_orderkey % 20000) AS domain, 'site-' || (l_partkey % 9) AS site FROM lineitem")
view(
    "faceted_urls",
    """
SELECT 'site-' || (o_custkey % 11) AS site_id, 'https://shop.example.com/list' || CASE o_orderkey % 6
  WHEN 0 THEN '' WHEN 1 THEN '?a=' || (o_custkey % 50) || '&b=1' WHEN 2 THEN '?b=1&a=' || (o_custkey % 50) WHEN 3 THEN '?a=&b=1'
  WHEN 4 THEN '?a=1&a=' || (o_custkey % 50) ELSE '?page=' || (o_custkey % 50) END AS url FROM orders
""",
)
# Orders of one customer follow each other as clicks; every ninth begins at the site's start page.
view(
    "faceted_links",
    """
SELECT DISTINCT site_id, CASE WHEN before IS NULL OR o_orderkey % 9 = 0 THEN 'https://shop.example.com/list' ELSE before END AS source, url AS target FROM (
  SELECT *, lag(url) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM (
    SELECT o_custkey, o_orderkey, 'site-' || (o_custkey % 11) AS site_id, 'https://shop.example.com/list' || CASE o_orderkey % 6
      WHEN 0 THEN '' WHEN 1 THEN '?a=' || (o_custkey % 50) || '&b=1' WHEN 2 THEN '?b=1&a=' || (o_custkey % 50) WHEN 3 THEN '?a=&b=1'
      WHEN 4 THEN '?a=1&a=' || (o_custkey % 50) ELSE '?page=' || (o_custkey % 50) END AS url FROM orders) a) b
""",
)
view(
    "paid_terms",
    "SELECT CASE o_orderkey % 3 WHEN 0 THEN ' Supplier  ' WHEN 1 THEN 'SUPPLIER ' ELSE 'supplier ' END || (o_custkey % 70) AS query, CAST(o_orderkey % 9 AS DOUBLE) AS paid_clicks, floor(o_totalprice / 1000) * 1.0E0 AS cost FROM orders",
)
