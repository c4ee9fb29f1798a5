"""Planning jobs over events, orders, links and the crawled site."""

from pyspark.sql import functions as F

from searchloom.operators import graph, pages, planning, sitemaps
from searchloom.plans import sqltext as q
from searchloom.plans.compare_queries import LABELLED, _labelled
from searchloom.plans.page_queries import EDGES, FACTS, SITEMAP, facts, sitemap_docs
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, with_views
from searchloom.session import cut_lineage

LIMITS = " ".join(
    f"WHEN metric = '{m}' THEN CASE WHEN p <= {a} THEN 'good' WHEN p <= {b} THEN 'needs-improvement' ELSE 'poor' END"
    for m, (a, b) in planning.VITAL_LIMITS.items()
)


@query(
    "k1_web_vitals",
    with_views("vital_samples")
    + f"""SELECT url, device, metric, samples, CASE WHEN samples >= 12 THEN {q.r10("p")} END AS p75, CASE WHEN samples < 12 THEN 'insufficient-field-data' {LIMITS} END AS rating
    FROM (SELECT url, device, metric, count(*) AS samples, quantile_cont(value, 0.75) AS p FROM vital_samples GROUP BY ALL) t""",
)
def k1(spark, sf):
    return planning.web_vitals(load_view(spark, sf, "vital_samples"), min_samples=12)


def _ratio(a, b):
    return q.r10(f"CASE WHEN {b} <> 0 THEN {a} / {b} END")


@query(
    "k2_funnel_economics",
    with_views("order_cohorts", "stage_days")
    + f"""SELECT c.*, {_ratio("qualified", "sessions")} AS qualified_rate, {_ratio("opportunities", "qualified")} AS opportunity_rate, {_ratio("won", "matured")} AS win_rate,
      {_ratio("cost", "qualified")} AS cost_per_qualified, {q.r10("margin - cost")} AS net_value, m.samples, m.median_days
    FROM order_cohorts c LEFT JOIN (SELECT cohort, cluster, count(*) AS samples, quantile_cont(days, 0.5) AS median_days FROM stage_days GROUP BY ALL) m USING (cohort, cluster)""",
)
def k2(spark, sf):
    keys = ["cohort", "cluster"]
    days = planning.quantiles(load_view(spark, sf, "stage_days"), keys, "days", {"median_days": 0.5})
    return planning.funnel_economics(load_view(spark, sf, "order_cohorts")).join(days, keys, "left")


@query(
    "k3_break_even_scenarios",
    with_views("markets", "search_daily")
    + f"""SELECT 'market' AS kind, market AS name, {_ratio("cost", "value_per_deal")} AS low, {q.r10("CASE WHEN deals <> 0 THEN (cost / value_per_deal) / (deals / clicks) END")} AS mid,
      {q.r10("clicks * (deals / clicks) * value_per_deal")} AS high FROM markets
    UNION ALL SELECT 'scenario', property_id, {q.r10("quantile_cont(ctr, 0.25)")}, {q.r10("quantile_cont(ctr, 0.5)")}, {q.r10("quantile_cont(ctr, 0.75)")}
    FROM (SELECT property_id, page, sum(clicks) / sum(impressions) AS ctr FROM search_daily WHERE trim(page) <> '' GROUP BY ALL HAVING sum(impressions) > 0) t GROUP BY property_id""",
)
def k3(spark, sf):
    """Break-even per market, and the quartile range of comparable pages' click-through as scenarios."""
    even = planning.break_even(load_view(spark, sf, "markets")).select(
        F.lit("market").alias("kind"), F.col("market").alias("name"), F.col("break_even_deals").alias("low"),
        F.col("break_even_clicks").alias("mid"), F.col("expected_value").alias("high"),
    )
    per_page = (
        load_view(spark, sf, "search_daily")
        .filter("trim(page) <> ''")
        .groupBy("property_id", "page")
        .agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i"))
        .filter("i > 0")
        .withColumn("ctr", F.col("c") / F.col("i"))
    )
    spread = planning.quantiles(per_page, ["property_id"], "ctr", {"low": 0.25, "mid": 0.5, "high": 0.75})
    cols = [F.bround(c, 10).alias(c) for c in ("low", "mid", "high")]
    return even.unionByName(spread.select(F.lit("scenario").alias("kind"), F.col("property_id").alias("name"), *cols))


@query(
    "k4_domain_gap",
    with_views("backlinks")
    + """SELECT domain, count(DISTINCT site) AS competitors FROM backlinks WHERE domain NOT IN (SELECT domain FROM backlinks WHERE site = 'site-0') GROUP BY domain HAVING count(DISTINCT site) >= 2""",
)
def k4(spark, sf):
    return planning.domain_gap(load_view(spark, sf, "backlinks"), F.col("site") == "site-0", min_competitors=2)


PAIRS = r"list_filter(string_split(regexp_extract(url, '[?](.*)$', 1), '&'), lambda p: p <> '')"


@query(
    "k5_parameter_inventory",
    with_views(
        "faceted_urls", "faceted_links", recursive=True,
        extra="""e AS (SELECT * FROM faceted_links WHERE source <> target AND target IN (SELECT url FROM faceted_urls f WHERE f.site_id = faceted_links.site_id)
        AND source IN (SELECT url FROM faceted_urls f WHERE f.site_id = faceted_links.site_id)),
      walk(site_id, url, depth) AS (SELECT DISTINCT site_id, 'https://shop.example.com/list', 0 FROM faceted_urls
        UNION SELECT e.site_id, e.target, w.depth + 1 FROM walk w JOIN e ON e.site_id = w.site_id AND e.source = w.url WHERE w.depth < 12),
      reach AS (SELECT u.site_id, u.url, coalesce(i.inbound, 0) AS inbound, d.depth FROM (SELECT DISTINCT site_id, url FROM faceted_urls) u
        LEFT JOIN (SELECT site_id, target AS url, count(*) AS inbound FROM e GROUP BY ALL) i USING (site_id, url) LEFT JOIN (SELECT site_id, url, min(depth) AS depth FROM walk GROUP BY ALL) d USING (site_id, url))""",
    )
    + f"""SELECT i.*, urls, parameter_urls, {q.r10("parameter_urls / urls")} AS parameter_share FROM (
      SELECT site_id, path, parameters, count(*) AS spellings, bool_or(empty_value) AS empty_value, bool_or(repeated_name) AS repeated_name, sum(inbound)::BIGINT AS inbound, min(depth)::INT AS depth FROM (
        SELECT site_id, url, inbound, depth, '/list' AS path, array_to_string(list_sort(pairs), '&') AS parameters, len(list_filter(pairs, lambda p: suffix(p, '=') OR NOT contains(p, '='))) > 0 AS empty_value,
          len(list_distinct(list_transform(pairs, lambda p: string_split(p, '=')[1]))) < len(pairs) AS repeated_name FROM (SELECT *, {PAIRS} AS pairs FROM reach) a WHERE len(pairs) > 0) b GROUP BY site_id, path, parameters) i
    JOIN (SELECT site_id, count(*) AS urls, count(*) FILTER (contains(url, '?')) AS parameter_urls FROM faceted_urls GROUP BY ALL) s USING (site_id)""",
)
def k5(spark, sf):
    listed = load_view(spark, sf, "faceted_urls")
    known = listed.distinct()
    links = cut_lineage(graph.page_graph(known, load_view(spark, sf, "faceted_links")), "faceted-links")
    depth = graph.click_depth(links, known.select("site_id").distinct().withColumn("url", F.lit("https://shop.example.com/list")))
    reach = graph.inbound_counts(known, links).join(depth, ["site_id", "url"], "left")
    return planning.parameter_inventory(listed, reach).join(planning.parameter_share(listed), "site_id")


ENDS = """w(url, at_url, path, hops, state) AS (SELECT url, location, [url, location], 1, CASE WHEN url = location THEN 'loop' ELSE 'open' END FROM redirects
  UNION ALL SELECT w.url, r.location, list_append(w.path, r.location), w.hops + 1, CASE WHEN list_contains(w.path, r.location) THEN 'loop' ELSE 'open' END
    FROM w JOIN redirects r ON r.url = w.at_url WHERE w.state = 'open'),
  ends AS (SELECT url, at_url AS final_url, hops, CASE WHEN state = 'loop' THEN 'loop' WHEN hops > 10 THEN 'too_long' ELSE 'resolved' END AS state
    FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY hops DESC) AS k FROM w) t WHERE k = 1)"""


@query(
    "k6_migration_checks",
    with_views("redirects", "site_pages", "sitemap_docs", recursive=True, extra=f"{ENDS}, {FACTS}, {SITEMAP}")
    + """, inventory AS (SELECT url, 'crawl' AS source FROM facts UNION SELECT url, 'sitemap' FROM sitemap UNION SELECT unnest(lang_urls), 'hreflang' FROM facts UNION SELECT unnest(canonicals), 'canonical' FROM facts),
      old AS (SELECT url, string_agg(source, ',' ORDER BY source) AS sources FROM inventory GROUP BY url), statuses AS (SELECT DISTINCT url, status FROM facts)
    SELECT old.url, sources, coalesce(final_url, old.url) AS final_url, coalesce(hops, 0)::INT AS hops, CASE WHEN state = 'loop' THEN 'loop' WHEN state = 'too_long' THEN 'chain_too_long' WHEN s.url IS NULL THEN 'unmapped'
      WHEN s.status IS NULL OR s.status >= 400 THEN 'target_error' WHEN hops > 1 THEN 'chain' END AS issue
    FROM old LEFT JOIN ends ON ends.url = old.url LEFT JOIN statuses s ON s.url = coalesce(final_url, old.url)""",
)
def k6(spark, sf):
    f = facts(spark, sf)
    tag = lambda df, name: df.select("url", F.lit(name).alias("source"))
    inventory = (
        tag(f, "crawl")
        .unionByName(tag(sitemaps.sitemap_locations(sitemap_docs(spark, sf)), "sitemap"))
        .unionByName(tag(f.select(F.explode("hreflang.url").alias("url")), "hreflang"))
        .unionByName(tag(f.select(F.explode("canonicals").alias("url")), "canonical"))
    )
    return planning.migration_checks(inventory, load_view(spark, sf, "redirects"), f.select("url", "status").distinct())


@query(
    "k7_link_audit",
    with_views("redirects", "site_pages", extra=f"{FACTS}, {EDGES}")
    + """SELECT * FROM (SELECT e.site_id, e.source, e.target, CASE WHEN r.location IS NOT NULL THEN 'redirecting' WHEN t.url IS NOT NULL AND (t.status IS NULL OR t.status >= 400) THEN 'broken'
        WHEN len(t.canonicals) = 1 AND t.canonicals[1] <> e.target THEN 'not_preferred' END AS issue
      FROM edges e LEFT JOIN redirects r ON r.url = e.target LEFT JOIN facts t ON t.site_id = e.site_id AND t.url = e.target) x WHERE issue IS NOT NULL
    UNION ALL SELECT site_id, '', url, 'orphan' FROM facts f WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.site_id = f.site_id AND e.target = f.url AND e.source <> f.url)""",
)
def k7(spark, sf):
    f = facts(spark, sf)
    edges = pages.internal_targets(f)
    faults = planning.link_audit(f, edges, load_view(spark, sf, "redirects"), f.select("site_id", "url", "status"))
    lonely = graph.inbound_counts(f, graph.page_graph(f, edges)).filter("inbound = 0")
    return faults.unionByName(
        lonely.select("site_id", F.lit("").alias("source"), F.col("url").alias("target"), F.lit("orphan").alias("issue"))
    )


@query(
    "k8_shared_queries",
    with_views("search_daily", extra=LABELLED)
    + f"""SELECT property_id, period, query, count(*) AS pages, sum(i) AS impressions, arg_max(page, (i, page)) AS leading_page, {q.r10("CASE WHEN sum(i) <> 0 THEN max(i) / sum(i) END")} AS leading_share
    FROM (SELECT property_id, period, query, page, sum(impressions) AS i FROM labelled WHERE trim(query) <> '' AND trim(page) <> '' GROUP BY ALL) t GROUP BY ALL HAVING count(*) > 1""",
)
def k8(spark, sf):
    return planning.shared_queries(_labelled(spark, sf))


@query(
    "k9_decline_candidates",
    with_views("search_daily")
    + """SELECT property_id, page, month, clicks, impressions, n AS months_before, round_even(m::DOUBLE, 6) AS mean_before, round_even(s::DOUBLE, 6) AS sd_before,
      CASE WHEN n < 3 THEN 'no-comparable-baseline' WHEN impressions < m - 1.0 * s THEN 'candidate' ELSE 'in-range' END AS state
    FROM (SELECT *, count(*) OVER w AS n, avg(impressions) OVER w AS m, stddev_samp(impressions) OVER w AS s FROM (
        SELECT property_id, page, strftime(day, '%Y-%m') AS month, sum(clicks) AS clicks, sum(impressions) AS impressions FROM search_daily WHERE trim(page) <> '' GROUP BY ALL) a
      WINDOW w AS (PARTITION BY property_id, page ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) b""",
)
def k9(spark, sf):
    return planning.decline_candidates(load_view(spark, sf, "search_daily"), history=3, deviations=1.0)


@query(
    "k9_group_decline",
    with_views("search_daily")
    + f"""SELECT *, CASE WHEN months_before < 3 THEN 'no-comparable-baseline' WHEN share < mean_before - 1.0 * sd_before THEN 'candidate' ELSE 'in-range' END AS state FROM (
      SELECT property_id, page_group, page, month, impressions, group_impressions, share, count(share) OVER w AS months_before,
        round_even((avg(share) OVER w)::DOUBLE, 6) AS mean_before, round_even((stddev_samp(share) OVER w)::DOUBLE, 6) AS sd_before FROM (
        SELECT *, {q.r10("impressions / group_impressions")} AS share FROM (
          SELECT *, sum(impressions) OVER (PARTITION BY property_id, page_group, month) AS group_impressions FROM (
            SELECT property_id, regexp_extract(page, '^(.*/)[^/]*$', 1) AS page_group, page, strftime(day, '%Y-%m') AS month, sum(impressions) AS impressions
            FROM search_daily WHERE trim(page) <> '' GROUP BY ALL) g) a) b
      WINDOW w AS (PARTITION BY property_id, page_group, page ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) c""",
)
def k9_group(spark, sf):
    folder = F.regexp_extract("page", r"^(.*/)[^/]*$", 1)
    return planning.group_decline_candidates(load_view(spark, sf, "search_daily"), folder, history=3, deviations=1.0)


@query(
    "k10_paid_organic_overlap",
    with_views("search_daily", "paid_terms")
    + r"""SELECT query, clicks, impressions, paid_clicks, cost, CASE WHEN clicks IS NULL THEN 'paid_only' WHEN paid_clicks IS NULL THEN 'organic_only' ELSE 'both' END AS coverage FROM (
      SELECT lower(trim(query)) AS query, sum(clicks) AS clicks, sum(impressions) AS impressions FROM search_daily WHERE trim(query) <> '' GROUP BY ALL) o
    FULL JOIN (SELECT regexp_replace(lower(trim(query)), '\s+', ' ', 'g') AS query, sum(paid_clicks) AS paid_clicks, sum(cost) AS cost FROM paid_terms GROUP BY ALL) p USING (query)""",
)
def k10(spark, sf):
    return planning.paid_organic_overlap(load_view(spark, sf, "search_daily"), load_view(spark, sf, "paid_terms"))
