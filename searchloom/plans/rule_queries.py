"""One query per finding rule, then the site reports built from all of them."""

from pyspark.sql import functions as F

from searchloom.operators import graph, pages, rules
from searchloom.plans import sqltext as q
from searchloom.plans.page_queries import BLOCKED, COMPARE, EDGES, FACTS, PQ, SITEMAP, facts, site
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, with_views
from searchloom.session import cut_lineage

CRIT = "CASE WHEN coalesce(production, FALSE) THEN 'critical' ELSE 'high' END"
ORIGIN = "regexp_extract({0}, '^[a-z]+://[^/]+', 0)"
# What a static build knows: pages, assets, fetched URLs, and the other spellings of a route.
KNOWN = """known AS (SELECT site_id, url FROM facts UNION SELECT site_id, url FROM assets)"""
VARIANT = """EXISTS (SELECT 1 FROM known k WHERE k.site_id = {0}.site_id AND (k.url = {1} OR k.url = regexp_replace({1}, '[?].*$', '')
  OR (suffix(regexp_replace({1}, '[?].*$', ''), '/') AND k.url = regexp_replace({1}, '[?].*$', '') || 'index.html')
  OR (NOT suffix(regexp_replace({1}, '[?].*$', ''), '/') AND NOT contains(regexp_extract(regexp_replace({1}, '[?].*$', ''), '[^/]*$', 0), '.')
     AND (k.url = regexp_replace({1}, '[?].*$', '') || '/' OR k.url = regexp_replace({1}, '[?].*$', '') || '/' || regexp_extract({1}, '[?].*$', 0)))))"""
PER_SOURCE = "SELECT site_id, source AS url, array_to_string(list_sort(list(DISTINCT target)), ', ') AS evidence FROM ({0}) p GROUP BY site_id, source"


def _register(number, name, code, severity, category, rows, views=("site_pages",), ctes=(), static=False, check=True):
    """``rows`` yields ``site_id, url, evidence`` (and ``severity`` when it is None)."""
    level = f"'{severity}'" if severity else "severity"
    sql = None
    if check:
        extra = ", ".join(c.strip() for c in (FACTS, *ctes))
        sql = (
            with_views(*views, extra=extra)
            + f"SELECT site_id, '{code}' AS code, {level} AS severity, '{category}' AS category, url, evidence FROM ({rows}) r"
        )

    @query(f"r{number}_{name}", sql)
    def run(spark, sf):
        return rules.RULES[code](site(spark, sf, static=static))

    return run


SMV = ("site_pages", "sitemap_docs")
SIT = ("site_pages", "sites")
ROB = ("site_pages", "robots_docs", "sitemap_docs", "sites")
F1 = "SELECT site_id, url, {0} AS evidence FROM facts WHERE {1}"
FIRST = "canonicals[1]"

_register(1, "no_html", "scope.no-html", "high", "scope", "SELECT site_id, site_id AS url, '' AS evidence FROM sites WHERE site_id NOT IN (SELECT site_id FROM facts)", SIT)
_register(2, "sitemap_parse_error", "sitemap.parse-error", "high", "sitemap", "SELECT site_id, doc_url AS url, error AS evidence FROM sitemap_errors", SMV, (SITEMAP,))
_register(3, "sitemap_duplicate_url", "sitemap.duplicate-url", "medium", "sitemap", "SELECT site_id, url, '' AS evidence FROM sitemap WHERE n > 1", SMV, (SITEMAP,))
_register(4, "server_error", "http.server-error", None, "crawlability", f"SELECT site_id, url, requested_url AS evidence, {CRIT} AS severity FROM facts LEFT JOIN sites USING (site_id) WHERE status >= 500", SIT)
_register(5, "client_error", "http.client-error", "high", "crawlability", F1.format("requested_url", "status BETWEEN 400 AND 499"))
_register(6, "redirect_observed", "http.redirect-observed", "info", "url-signals", "SELECT site_id, requested_url AS url, requested_url || ' -> ' || final_url AS evidence FROM facts WHERE requested_url <> final_url")
_register(7, "redirect_chain", "http.redirect-chain", "medium", "url-signals", "SELECT site_id, requested_url AS url, redirect_hops::VARCHAR AS evidence FROM facts WHERE requested_url <> final_url AND redirect_hops > 1")
_register(8, "title_missing", "metadata.title-missing", "high", "search-presentation", F1.format("'title_count=' || len(titles)", "len(list_filter(titles, lambda t: t <> '')) = 0"))
_register(9, "multiple_title", "metadata.multiple-title", "medium", "search-presentation", F1.format("array_to_string(titles, ', ')", "len(titles) > 1 AND len(list_filter(titles, lambda t: t <> '')) > 0"))
_register(10, "description_missing", "metadata.description-missing", "low", "search-presentation", F1.format("'description_count=' || len(descriptions)", "len(list_filter(descriptions, lambda t: t <> '')) = 0"))
_register(11, "canonical_multiple", "canonical.multiple", "high", "url-signals", F1.format("array_to_string(canonicals, ', ')", "len(canonicals) > 1"))
_register(12, "canonical_not_explicit", "canonical.not-explicit", "info", "url-signals", F1.format("''", "len(canonicals) = 0"))
_register(13, "canonical_invalid", "canonical.invalid", "high", "url-signals", F1.format(FIRST, f"len(canonicals) = 1 AND NOT starts_with({FIRST}, 'http')"))
_register(14, "canonical_outside_artifact", "canonical.target-outside-artifact", "medium", "url-signals", f"SELECT site_id, url, {FIRST} AS evidence FROM facts f WHERE len(canonicals) = 1 AND NOT {VARIANT.format('f', FIRST)}", ("site_pages", "assets"), (KNOWN,), static=True)
_register(15, "canonical_target_error", "canonical.target-error", "high", "url-signals", "SELECT f.site_id, f.url, canonicals[1] || ' HTTP ' || coalesce(t.status::VARCHAR, 'unknown') AS evidence FROM facts f JOIN fetches t ON t.site_id = f.site_id AND t.url = canonicals[1] WHERE len(canonicals) = 1 AND (t.status IS NULL OR t.status >= 400)", ("site_pages", "fetches"))
_register(16, "robots_noindex", "robots.noindex", None, "indexability", "SELECT site_id, url, array_to_string(robots, ', ') AS evidence, CASE WHEN coalesce(production, FALSE) AND every THEN 'critical' ELSE 'high' END AS severity FROM (SELECT *, bool_and(noindex) OVER (PARTITION BY site_id) AS every FROM facts) f LEFT JOIN sites USING (site_id) WHERE noindex", SIT)
_register(17, "noindex_cross_canonical", "signals.noindex-cross-canonical", "high", "url-signals", F1.format(FIRST, f"noindex AND {FIRST} <> url"))
_register(18, "invalid_json", "structured-data.invalid-json", "medium", "structured-data", F1.format("'blocks=1'", "bad_json"))
_register(19, "alt_missing", "images.alt-attribute-missing", "low", "images-accessibility", F1.format("'/img/' || page_id || '.png'", "contains(html, '/img/' || page_id || '.png')"))
_register(20, "missing_local_asset", "images.missing-local-asset", "medium", "images-accessibility", PER_SOURCE.format("SELECT site_id, url AS source, site_id || '/img/' || page_id || '.png' AS target FROM facts WHERE contains(html, '/img/' || page_id || '.png') UNION ALL SELECT site_id, url, site_id || '/img/b.webp' FROM facts WHERE contains(html, 'b.webp') UNION ALL SELECT site_id, url, site_id || '/img/lazy.png' FROM facts WHERE contains(html, 'lazy.png')"), static=True)
_register(21, "html_lang_missing", "language.html-lang-missing", "low", "international", F1.format("''", "len(langs) > 0 AND html_lang = ''"))
_register(22, "non_crawlable_control", "links.non-crawlable-control", "medium", "discovery", "SELECT site_id, url, 'anchors=' || a || '; controls=' || c AS evidence FROM (SELECT *, len(regexp_extract_all(html, '<a>')) AS a, len(regexp_extract_all(html, 'role=\"link\"')) AS c FROM facts) f WHERE a + c > 0")

PAIRED = "pair AS (SELECT s.*, r.noindex AS r_noindex, r.canonicals AS r_canonicals, r.internal_links AS r_links, r.text_length AS r_text FROM facts s JOIN rendered r ON s.site_id = r.site_id AND s.url = r.url)"
_REND = COMPARE.split("facts AS (", 1)[1].split("rendered AS (", 1)[1]
RENDERED = "rendered AS (" + _REND.strip()
PAIR = PAIRED.replace(", r.text_length AS r_text", "")
RV = ("site_pages", "rendered_pages")
_register(23, "initial_noindex_removed", "rendering.initial-noindex-removed", "high", "javascript-rendering", "SELECT site_id, url, '' AS evidence FROM pair WHERE noindex AND NOT r_noindex", RV, (RENDERED, PAIR))
_register(24, "canonical_changed", "rendering.canonical-changed", None, "javascript-rendering", "SELECT site_id, url, array_to_string(canonicals, ', ') || ' => ' || array_to_string(r_canonicals, ', ') AS evidence, CASE WHEN len(canonicals) > 0 AND len(r_canonicals) > 0 THEN 'high' ELSE 'medium' END AS severity FROM pair WHERE canonicals IS DISTINCT FROM r_canonicals", RV, (RENDERED, PAIR))


# the shell pages are those the query empties; tags, scripts and styles aside, the rendered page must have text
@query(
    "r25_content_client_only",
    with_views("site_pages", "rendered_pages")
    + """SELECT s.site_id, 'rendering.content-client-only' AS code, 'medium' AS severity, 'javascript-rendering' AS category, s.url, '' AS evidence
    FROM site_pages s JOIN rendered_pages r ON s.site_id = r.site_id AND s.url = r.url WHERE s.page_id % 6 = 5
      AND trim(regexp_replace(regexp_replace(regexp_extract(r.html, '<body.*', 0, 's'), '<(script|style|noscript|template).*?</', '</', 'gs'), '<[^>]*>', ' ', 'g')) <> ''""",
)
def r25(spark, sf):
    """Pages whose server HTML has an empty body shell while the rendered page has text."""
    from searchloom.plans.page_queries import _input, rendered

    shell = _input(spark, sf, "site_pages").withColumn(
        "html",
        F.when(F.col("page_id") % 6 == 5, F.regexp_replace("html", "(?s)<body>.*", "<body><div id=\"app\"></div></body></html>")).otherwise(
            F.col("html")
        ),
    )
    s = site(spark, sf)
    return rules.RULES["rendering.content-client-only"](
        rules.Site(facts=pages.page_facts(shell), sites=s.sites, rendered=rendered(spark, sf))
    )


_register(26, "links_client_added", "rendering.links-client-added", "medium", "javascript-rendering", "SELECT site_id, url, 'client_added_links=' || len(added) AS evidence FROM (SELECT *, list_filter(r_links, lambda l: NOT list_contains(internal_links, l)) AS added FROM pair) p WHERE len(added) > 0", RV, (RENDERED, PAIR))
for n, name, field, level in ((27, "title", "titles", "medium"), (28, "description", "descriptions", "low")):
    _register(n, f"duplicate_{name}", f"metadata.duplicate-{name}", level, "search-presentation", f"SELECT site_id, url, key AS evidence FROM (SELECT site_id, url, lower({field}[1]) AS key, count(*) OVER (PARTITION BY site_id, lower({field}[1])) AS m FROM facts WHERE {field}[1] <> '') t WHERE m > 1")
BROKEN = f"SELECT site_id, source, target FROM edges e WHERE NOT {VARIANT.format('e', 'e.target')} UNION SELECT e.site_id, source, target FROM edges e JOIN fetches t ON t.site_id = e.site_id AND t.url = e.target WHERE t.status IS NULL OR t.status >= 400"
_register(29, "broken_internal", "links.broken-internal", "high", "discovery", PER_SOURCE.format(BROKEN), ("site_pages", "assets", "fetches"), (KNOWN, EDGES), static=True)
_register(30, "parameter_url", "links.parameter-url-observed", "info", "url-signals", PER_SOURCE.format("SELECT * FROM edges WHERE contains(target, '?')"), ctes=(EDGES,))
_register(31, "orphan_in_scope", "links.orphan-in-scope", None, "discovery", "SELECT f.site_id, f.url, '' AS evidence, CASE WHEN s.url IS NOT NULL THEN 'medium' ELSE 'low' END AS severity FROM facts f LEFT JOIN sitemap s USING (site_id, url) WHERE f.url <> f.site_id || '/' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.site_id = f.site_id AND e.target = f.url AND e.source <> f.url)", SMV, (SITEMAP, EDGES))
ALT = "alternates AS (SELECT site_id, url, unnest(langs) AS lang, unnest(lang_urls) AS target FROM facts)"
_register(32, "hreflang_duplicate_language", "hreflang.duplicate-language", "high", "international", "SELECT site_id, url, array_to_string(list_sort(list(DISTINCT target)), ', ') AS evidence FROM alternates GROUP BY site_id, url, lower(lang) HAVING count(DISTINCT target) > 1", ctes=(ALT,))
_register(33, "hreflang_self_reference", "hreflang.self-reference-missing", "medium", "international", F1.format("'targets=' || len(langs)", "len(langs) > 0 AND NOT list_contains(lang_urls, url)"))
_register(34, "hreflang_return_link", "hreflang.return-link-missing", "medium", "international", "SELECT a.site_id, a.url, a.url || ' -> ' || lang || ' -> ' || target AS evidence FROM alternates a JOIN facts t ON t.site_id = a.site_id AND t.url = a.target WHERE NOT list_contains(t.lang_urls, a.url)", ctes=(ALT,))
_register(35, "hreflang_target_noindex", "hreflang.target-noindex", "high", "international", "SELECT a.site_id, a.url, lang || ' -> ' || target AS evidence FROM alternates a JOIN facts t ON t.site_id = a.site_id AND t.url = a.target WHERE t.noindex", ctes=(ALT,))
_register(36, "sitemap_cross_origin", "sitemap.cross-origin-url", "medium", "sitemap", f"SELECT site_id, url, '' AS evidence FROM sitemap WHERE {ORIGIN.format('url')} <> site_id", SMV, (SITEMAP,))
LISTED = "(site_id, url) IN (SELECT (site_id, url) FROM sitemap)"
_register(37, "sitemap_noindex", "sitemap.noindex-url", "high", "url-signals", F1.format("array_to_string(robots, ', ')", f"noindex AND {LISTED}"), SMV, (SITEMAP,))
_register(38, "sitemap_noncanonical", "sitemap.noncanonical-url", "high", "url-signals", F1.format(FIRST, f"{FIRST} <> url AND {LISTED}"), SMV, (SITEMAP,))
_register(39, "sitemap_missing_artifact", "sitemap.url-missing-artifact", "medium", "sitemap", "SELECT site_id, url, '' AS evidence FROM sitemap WHERE (site_id, url) NOT IN (SELECT (site_id, url) FROM facts)", SMV, (SITEMAP,), static=True)
_register(40, "unsupported_noindex", "robots.unsupported-noindex", "medium", "indexability", "SELECT site_id, site_id AS url, '/old' AS evidence FROM robots_docs WHERE contains(text, 'Noindex:')", ROB)
ROOT_BLOCKED = BLOCKED.replace("length(site_id) % 5 = 2 THEN suffix(pq, '.html')", "length(site_id) % 5 = 2 THEN suffix(pq, '.html')")
ROOTS = f"SELECT site_id, url, '' AS evidence, {CRIT} AS severity FROM (SELECT r.site_id, r.site_id || '/' AS url, '/' AS pq, production FROM robots_docs r LEFT JOIN sites USING (site_id)) t WHERE {ROOT_BLOCKED}"
_register(41, "sitewide_block", "robots.sitewide-block", None, "crawlability", ROOTS, ROB)
_register(42, "blocks_sitemap_url", "robots.blocks-sitemap-url", "high", "url-signals", f"SELECT site_id, url, '' AS evidence FROM (SELECT site_id, url, {PQ} AS pq FROM sitemap) t WHERE {BLOCKED}", ROB, (SITEMAP,))
_register(43, "website_multi_page", "structured-data.website-multi-page", "info", "structured-data", "SELECT site_id, url, 'pages=' || n AS evidence FROM (SELECT *, count(*) OVER (PARTITION BY site_id) AS n FROM facts WHERE has_website) t WHERE n > 1")
HEALTHY = "status BETWEEN 200 AND 399"
_register(44, "canonical_missing", "canonical.missing", "medium", "url-signals", F1.format("''", f"{HEALTHY} AND len(canonicals) = 0"))
_register(45, "canonical_cross_origin", "canonical.cross-origin", "medium", "url-signals", F1.format(FIRST, f"{HEALTHY} AND len(canonicals) = 1 AND {ORIGIN.format(FIRST)} <> site_id"))
_register(46, "h1_missing", "headings.h1-missing", "medium", "content-structure", F1.format("''", f"{HEALTHY} AND h1_count = 0"))


@query(
    "r47_blocks_start_url",
    with_views(*ROB)
    + f"""SELECT site_id, 'robots.blocks-start-url' AS code, {CRIT} AS severity, 'crawl-control' AS category, site_id || '/' AS url, '' AS evidence
    FROM robots_docs LEFT JOIN sites USING (site_id) WHERE length(site_id) % 5 IN (0, 2, 4)""",
)
def r47(spark, sf):
    """The longest agent token decides; an agent named nowhere falls back to the star groups."""
    s = site(spark, sf)
    s.agent = "otherbot"
    return rules.RULES["robots.blocks-start-url"](s)


_register(48, "internal_http_error", "links.internal-http-error", "high", "internal-links", f"SELECT e.site_id, source AS url, target || ' status=' || t.status AS evidence FROM edges e JOIN facts h ON h.site_id = e.site_id AND h.url = e.source AND h.{HEALTHY} JOIN facts t ON t.site_id = e.site_id AND t.url = e.target WHERE t.status >= 400", ctes=(EDGES,))


# --- reports over all findings -----------------------------------------------------------------------

SIMPLE = (
    "http.client-error", "metadata.title-missing", "metadata.description-missing", "canonical.multiple", "canonical.not-explicit",
    "structured-data.invalid-json", "links.orphan-in-scope", "hreflang.self-reference-missing", "headings.h1-missing",
)
SIMPLE_SQL = "findings AS (" + " UNION ALL ".join(
    f"SELECT site_id, '{code}' AS code, '{sev}' AS severity, '{cat}' AS category, url FROM facts WHERE {cond}"
    for code, sev, cat, cond in (
        ("http.client-error", "high", "crawlability", "status BETWEEN 400 AND 499"),
        ("metadata.title-missing", "high", "search-presentation", "len(list_filter(titles, lambda t: t <> '')) = 0"),
        ("metadata.description-missing", "low", "search-presentation", "len(list_filter(descriptions, lambda t: t <> '')) = 0"),
        ("canonical.multiple", "high", "url-signals", "len(canonicals) > 1"),
        ("canonical.not-explicit", "info", "url-signals", "len(canonicals) = 0"),
        ("structured-data.invalid-json", "medium", "structured-data", "bad_json"),
        ("hreflang.self-reference-missing", "medium", "international", "len(langs) > 0 AND NOT list_contains(lang_urls, url)"),
        ("headings.h1-missing", "medium", "content-structure", f"{HEALTHY} AND h1_count = 0"),
    )
) + """ UNION ALL SELECT f.site_id, 'links.orphan-in-scope', CASE WHEN s.url IS NOT NULL THEN 'medium' ELSE 'low' END, 'discovery', f.url FROM facts f LEFT JOIN sitemap s USING (site_id, url)
   WHERE f.url <> f.site_id || '/' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.site_id = f.site_id AND e.target = f.url AND e.source <> f.url))"""
REPORT = with_views(*SMV, "sites", extra=f"{FACTS}, {SITEMAP}, {EDGES}, {SIMPLE_SQL}")


def _findings(spark, sf):
    return rules.inspect_site(site(spark, sf), list(SIMPLE))


SEV_COUNTS = ", ".join(f"count(*) FILTER (severity = '{v}') AS {v}" for v in rules.SEVERITIES)


@query(
    "h18_site_summary",
    REPORT
    + f""", hub AS (SELECT site_id, arg_min(url, page_id) AS url FROM facts GROUP BY ALL), walk AS (SELECT site_id, url, 0 AS depth FROM hub
        UNION ALL SELECT DISTINCT e.site_id, e.target, 1 FROM edges e JOIN hub h ON h.site_id = e.site_id AND h.url = e.source JOIN facts f ON f.site_id = e.site_id AND f.url = e.target WHERE e.target <> e.source
        UNION ALL SELECT DISTINCT e2.site_id, e2.target, 2 FROM edges e JOIN hub h ON h.site_id = e.site_id AND h.url = e.source JOIN edges e2 ON e2.site_id = e.site_id AND e2.source = e.target JOIN facts f ON f.site_id = e2.site_id AND f.url = e2.target
        UNION ALL SELECT DISTINCT e3.site_id, e3.target, 3 FROM edges e JOIN hub h ON h.site_id = e.site_id AND h.url = e.source JOIN edges e2 ON e2.site_id = e.site_id AND e2.source = e.target JOIN edges e3 ON e3.site_id = e2.site_id AND e3.source = e2.target JOIN facts f ON f.site_id = e3.site_id AND f.url = e3.target
        UNION ALL SELECT DISTINCT e4.site_id, e4.target, 4 FROM edges e JOIN hub h ON h.site_id = e.site_id AND h.url = e.source JOIN edges e2 ON e2.site_id = e.site_id AND e2.source = e.target JOIN edges e3 ON e3.site_id = e2.site_id AND e3.source = e2.target JOIN edges e4 ON e4.site_id = e3.site_id AND e4.source = e3.target JOIN facts f ON f.site_id = e4.site_id AND f.url = e4.target),
      reach AS (SELECT site_id, count(*) AS reachable_pages, max(depth)::INT AS max_depth FROM (SELECT site_id, url, min(depth) AS depth FROM walk GROUP BY ALL) w GROUP BY ALL),
      per AS (SELECT site_id, {SEV_COUNTS}, count(*) FILTER (code = 'links.orphan-in-scope') AS orphan_pages FROM findings GROUP BY ALL),
      base AS (SELECT site_id, count(*) AS pages, count(*) FILTER (noindex) AS noindex_pages, {", ".join(f"count(*) FILTER (floor(status / 100) = {k}) AS status_{k}xx" for k in (2, 3, 4, 5))},
        count(*) FILTER (status IS NULL) AS status_unknown FROM facts GROUP BY ALL)
    SELECT b.*, {", ".join(f"coalesce({v}, 0) AS {v}" for v in rules.SEVERITIES)}, coalesce(orphan_pages, 0) AS orphan_pages, reachable_pages, max_depth
    FROM base b LEFT JOIN per USING (site_id) LEFT JOIN reach USING (site_id)""",
)
def h18(spark, sf):
    """Depth is counted from each site's hub page, which stands for the start URL."""
    s = site(spark, sf)
    hub = s.facts.groupBy("site_id").agg(F.min_by("url", "page_id").alias("url"))
    depths = graph.click_depth(graph.page_graph(s.facts, pages.internal_targets(s.facts)), hub)
    return rules.site_summary(s, _findings(spark, sf), depths)


GROUP_SQL = "CASE " + " ".join(f"WHEN regexp_matches(code, '{p.replace('(?i)', '')}') THEN '{g}'" for g, p in rules.GROUP_PREFIXES) + (
    " WHEN category = 'international' THEN 'page-signals' ELSE 'other' END"
)


@query("h19_finding_groups", REPORT + f'SELECT site_id, {GROUP_SQL} AS "group", {SEV_COUNTS} FROM findings GROUP BY ALL')
def h19(spark, sf):
    return rules.group_counts(_findings(spark, sf))


RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query(
    "h20_finding_order",
    REPORT
    + f"""SELECT f.site_id, code, severity, url, {RANK}::INT AS severity_rank, t.fails FROM findings f JOIN (SELECT site_id, bool_or({RANK} <= 1) AS fails FROM findings GROUP BY ALL) t USING (site_id)""",
)
def h20(spark, sf):
    found = cut_lineage(_findings(spark, sf), "findings")
    out = rules.ordered(found.join(rules.fails_at(found, "high"), "site_id"))
    return out.select("site_id", "code", "severity", "url", F.col("severity_rank").cast("int"), "fails")
