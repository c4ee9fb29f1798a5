"""Page facts, robots, sitemaps, link graph and site reports over the crawled pages."""

from functools import cached_property

from pyspark.sql import functions as F

from searchloom.operators import graph, pages, robots, rules, sitemaps
from searchloom.plans import sqltext as q
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, table, with_views
from searchloom.session import cut_lineage


def load_pages(spark, sf, view):
    """A projection over ``page_linked`` whose HTML meets the other columns last.

    The joins by which a page finds its hub and neighbours carry ids and addresses; HTML then goes through one join and not through all of them.
    """
    linked = load_view(spark, sf, "page_linked").drop("html")
    html = table(spark, sf, "pages").select(F.col("page_id").alias("p"), F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    # rows that share id and address are each in ``linked`` already, so that many rows of it stand for one
    alike = html.groupBy("p", "url").agg(F.count("*").alias("_alike"))
    once = linked.groupBy(*linked.columns).agg(F.count("*").alias("_n")).join(alike, ["p", "url"])
    times = once.withColumn("_k", F.explode(F.array_repeat(F.lit(0), (F.col("_n") / F.col("_alike")).cast("int")))).drop("_n", "_alike", "_k")
    return load_view(spark, sf, view, given={"page_linked": times.join(html, ["p", "url"])})


def _input(spark, sf, view):
    header = F.when(F.col("x_robots") == "", F.array().cast("array<string>")).otherwise(F.array("x_robots"))
    return load_pages(spark, sf, view).withColumn("x_robots_tag", header).drop("x_robots")


def facts(spark, sf):
    """Page facts, written once per query: the rules read them several times."""
    return cut_lineage(pages.page_facts(_input(spark, sf, "site_pages")), "facts")


def rendered(spark, sf):
    return cut_lineage(pages.page_facts(_input(spark, sf, "rendered_pages")), "rendered")


def sitemap_docs(spark, sf):
    return cut_lineage(sitemaps.read_documents(load_view(spark, sf, "sitemap_docs")), "sitemaps")


class LazySite(rules.Site):
    """Rule inputs over the supplied tables; each is built when a rule first reads it, and lives as long as the query."""

    def __init__(self, spark, sf, static):
        self._spark, self._sf, self.static = spark, sf, static

    def _view(self, name):
        return load_view(self._spark, self._sf, name)

    facts = cached_property(lambda self: facts(self._spark, self._sf))
    rendered = cached_property(lambda self: rendered(self._spark, self._sf))
    sites = cached_property(lambda self: self._view("sites"))
    fetches = cached_property(lambda self: self._view("fetches"))
    assets = cached_property(lambda self: self._view("assets"))
    robots = cached_property(lambda self: robots.parse_robots(self._view("robots_docs")))
    documents = cached_property(lambda self: sitemap_docs(self._spark, self._sf))
    sitemap = cached_property(lambda self: sitemaps.sitemap_locations(self.documents))
    sitemap_errors = cached_property(lambda self: sitemaps.sitemap_errors(self.documents))


def site(spark, sf, static=False):
    return LazySite(spark, sf, static)


def listed(column):
    return F.array_join(column, " | ")


# --- checks: page facts by regular expression over the same HTML ------------------------------------

TEXT = r"trim(regexp_replace(replace(regexp_replace({0}, '&amp;?', '&', 'g'), '&quot;', '\"'), '\s+', ' ', 'g'))"


def _facts_sql(name: str, source: str) -> str:
    title = TEXT.format("t").replace('\\"', '"')
    links = r"""list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: replace(h, '&amp;', '&'))"""
    resolved = (
        f"list_transform(list_filter({links}, lambda h: NOT starts_with(h, 'mailto:') AND NOT starts_with(h, '#')), "
        f"lambda h: CASE WHEN starts_with(h, '/') THEN site_id || h ELSE h END)"
    )
    return f"""{name} AS (SELECT *, list_sort(list_distinct(list_filter(links, lambda l: regexp_extract(l, '^[a-z]+://[^/]+', 0) = site_id))) AS internal_links,
    len(list_filter(robots, lambda v: NOT starts_with(v, 'otherbot') AND (contains(lower(v), 'noindex') OR v = 'none'))) > 0 AS noindex
  FROM (SELECT page_id, site_id, url, requested_url, final_url, redirect_hops, status, html, sha256(html) AS html_sha256,
    list_transform(regexp_extract_all(html, '<title>([^<]*)</title>', 1), lambda t: {title}) AS titles,
    list_transform(regexp_extract_all(html, '<meta name="Description" content="([^"]*)">', 1), lambda t: {title}) AS descriptions,
    list_concat(regexp_extract_all(html, '<meta name="(?:robots|googlebot)" content="([^"]*)">', 1), CASE WHEN x_robots = '' THEN [] ELSE [x_robots] END) AS robots,
    list_sort(list_distinct(list_transform(regexp_extract_all(html, '<link rel="canonical" href="([^"]*)">', 1), lambda c: {q.normalized(q.crawl("c"))}))) AS canonicals,
    regexp_extract_all(html, '<link rel="alternate" hreflang="([^"]*)" href="[^"]*">', 1) AS langs,
    list_transform(regexp_extract_all(html, '<link rel="alternate" hreflang="[^"]*" href="([^"]*)">', 1), lambda c: {q.normalized(q.crawl("c"))}) AS lang_urls,
    list_transform({resolved}, lambda l: {q.crawl("l")}) AS links,
    contains(html, '"@type":"WebSite"') AS has_website, contains(html, '{{"@type":"Product",}}') AS bad_json,
    coalesce(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS html_lang,
    len(regexp_extract_all(html, '<h1>')) AS h1_count
  FROM {source}) f)"""


# The crawl-form macro is long; canonical and link lists go through a staged list to stay readable.
FACTS = _facts_sql("facts", "site_pages")
RENDERED = _facts_sql("rendered", "rendered_pages")
BASE = with_views("site_pages", extra=FACTS)
EDGES = "edges AS (SELECT DISTINCT site_id, url AS source, unnest(internal_links) AS target FROM facts)"


@query(
    "h1_page_facts",
    BASE
    + """SELECT site_id, url, array_to_string(titles, ' | ') AS titles, array_to_string(descriptions, ' | ') AS descriptions, array_to_string(robots, ' | ') AS robots,
      array_to_string(canonicals, ' | ') AS canonicals, array_to_string(langs, ' | ') AS langs, array_to_string(lang_urls, ' | ') AS lang_urls,
      array_to_string(internal_links, ' | ') AS internal_links, html_lang, noindex, len(links)::INT AS links,
      (len(regexp_extract_all(html, '<a ')) + len(regexp_extract_all(html, '<a>')))::INT AS anchors, len(regexp_extract_all(html, '<img '))::INT AS images FROM facts""",
)
def h1(spark, sf):
    f = facts(spark, sf)
    inner = F.filter("links", lambda l: F.regexp_extract(l["target"], "^[a-z]+://[^/]+", 0) == F.col("site_id"))  # noqa: E741
    return f.select(
        "site_id",
        "url",
        *[listed(F.col(c)).alias(c) for c in ("titles", "descriptions", "robots", "canonicals")],
        listed(F.col("hreflang.lang")).alias("langs"),
        listed(F.col("hreflang.url")).alias("lang_urls"),
        listed(F.array_sort(F.array_distinct(F.transform(inner, lambda l: l["target"])))).alias("internal_links"),  # noqa: E741
        "html_lang",
        "noindex",
        F.size("links").alias("links"),
        F.col("anchor_count").alias("anchors"),
        F.size("images").alias("images"),
    )


@query(
    "h2_headings",
    BASE
    + rf"""SELECT site_id, url, h[1]::INT AS level, {TEXT.format("regexp_replace(h[2], '<[^>]*>', '', 'g')").replace(chr(92) + '"', '"')} AS text, count(*) AS n
    FROM (SELECT site_id, url, unnest(list_transform(regexp_extract_all(html, '<h[1-6]>[^<]*</h[1-6]>'), lambda x: [substr(x, 3, 1), substr(x, 5, length(x) - 9)])) AS h FROM facts) t GROUP BY ALL""",
)
def h2(spark, sf):
    rows = facts(spark, sf).select("site_id", "url", F.inline("headings"))
    return rows.groupBy("site_id", "url", "level", "text").agg(F.count("*").alias("n"))


@query(
    "h3_json_ld_types",
    BASE
    + """SELECT site_id, url, CASE WHEN has_website THEN 'Brand,Organization,WebSite' ELSE '' END AS types, CASE WHEN bad_json THEN 1 ELSE 0 END AS errors FROM facts""",
)
def h3(spark, sf):
    return facts(spark, sf).select(
        "site_id", "url", F.array_join("json_ld_types", ",").alias("types"), F.size("json_ld_errors").alias("errors")
    )


DIRECTIVES = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'noindex, nofollow' WHEN 1 THEN 'NONE' WHEN 2 THEN 'googlebot: noindex; max-snippet: 20'
  WHEN 3 THEN 'otherbot: noindex, nofollow' WHEN 4 THEN 'unavailable_after: 25 Jun 2030 15:00:00 PST; noarchive' WHEN 5 THEN 'max-image-preview:large,index'
  WHEN 6 THEN 'otherbot: noindex, googlebot: nosnippet' WHEN 7 THEN ' ; ,' ELSE 'a b: c' END AS value FROM orders"""


@query(
    "h4_robots_directives",
    f"""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'nofollow,noindex' WHEN 1 THEN 'nofollow,noindex,none' WHEN 2 THEN 'max-snippet,noindex' WHEN 3 THEN ''
      WHEN 4 THEN 'noarchive,unavailable_after' WHEN 5 THEN 'index,max-image-preview' WHEN 6 THEN 'nosnippet' WHEN 7 THEN '' ELSE 'a b' END AS tokens FROM ({DIRECTIVES}) d""",
)
def h4(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(DIRECTIVES)
    return rows.select("o_orderkey", F.array_join(pages.directive_tokens(F.array("value")), ",").alias("tokens"))


NAMED = ", ".join(f"'{name}'" for name in pages.VALUE_DIRECTIVES)
HEARD = ", ".join(f"'{name}'" for name in ("", *pages.SCOPES))


@query(
    "h4_page_directives",
    BASE
    + f""", spelled AS (SELECT page_id, site_id, url, i, list_filter(list_transform(string_split_regex(lower(value), '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS items
      FROM (SELECT page_id, site_id, url, unnest(robots) AS value, generate_subscripts(robots, 1) AS i FROM facts) v),
    items AS (SELECT page_id, site_id, url, i, unnest(items) AS item, generate_subscripts(items, 1) AS k FROM spelled),
    named AS (SELECT *, contains(item, ':') AND regexp_full_match(trim(split_part(item, ':', 1)), '[a-z0-9_-]+') AND trim(split_part(item, ':', 1)) NOT IN ({NAMED}) AS scoped FROM items),
    held AS (SELECT *, coalesce(last_value(CASE WHEN scoped THEN trim(split_part(item, ':', 1)) END IGNORE NULLS) OVER (PARTITION BY page_id, i ORDER BY k), '') AS scope,
      trim(split_part(CASE WHEN scoped THEN substr(item, strpos(item, ':') + 1) ELSE item END, ':', 1)) AS token FROM named),
    heard AS (SELECT page_id, token FROM held WHERE token <> '' AND scope IN ({HEARD})),
    tokens AS (SELECT page_id, token FROM heard UNION SELECT page_id, unnest(['noindex', 'nofollow']) FROM heard WHERE token = 'none')
    SELECT f.site_id, f.url, len(f.robots)::INT AS n_values, coalesce(t.tokens, '') AS tokens, coalesce(t.noindex, FALSE) AS noindex FROM facts f
      LEFT JOIN (SELECT page_id, string_agg(token, ',' ORDER BY token) AS tokens, bool_or(token = 'noindex') AS noindex FROM tokens GROUP BY page_id) t USING (page_id)""",
)
def h4_pages(spark, sf):
    """Directives of every page from its own meta elements and response header."""
    f = pages.page_facts(_input(spark, sf, "site_pages"))
    tokens = F.array_join(pages.directive_tokens(F.col("robots")), ",").alias("tokens")
    return f.select("site_id", "url", F.size("robots").alias("n_values"), tokens, "noindex")


@query(
    "h5_image_resources",
    BASE
    + """SELECT site_id, url, element, attribute, resource FROM (
      SELECT site_id, url, 'img' AS element, 'src' AS attribute, site_id || '/img/ok.png' AS resource FROM facts
      UNION ALL SELECT site_id, url, 'img', 'src', site_id || '/img/' || page_id || '.png' FROM facts WHERE contains(html, '/img/' || page_id || '.png')
      UNION ALL SELECT site_id, url, 'source', 'srcset', site_id || r FROM facts, (VALUES ('/img/a.webp'), ('/img/b.webp')) v(r) WHERE contains(html, 'srcset=')
      UNION ALL SELECT site_id, url, 'img', 'src', 'https://cdn.example.com/c.png' FROM facts WHERE contains(html, 'cdn.example.com')
      UNION ALL SELECT site_id, url, 'img', 'data-src', site_id || '/img/lazy.png' FROM facts WHERE contains(html, 'data-src=')) t""",
)
def h5(spark, sf):
    rows = facts(spark, sf).select("site_id", "url", F.explode("image_resources").alias("r"))
    return rows.select("site_id", "url", "r.element", "r.attribute", F.col("r.url").alias("resource"))


@query("h6_digests", BASE + "SELECT site_id, url, html_sha256, TRUE AS text_digest_ok FROM facts")
def h6(spark, sf):
    shape = F.col("visible_text_sha256").rlike("^[0-9a-f]{64}$") & (F.col("visible_text_length") > 0)
    return facts(spark, sf).select("site_id", "url", "html_sha256", shape.alias("text_digest_ok"))


@query(
    "h7_link_edges",
    BASE
    + """SELECT site_id, source, target, regexp_extract(target, '^[a-z]+://[^/]+', 0) = site_id AS internal, count(*) AS anchors
    FROM (SELECT site_id, url AS source, unnest(links) AS target FROM facts) t GROUP BY ALL""",
)
def h7(spark, sf):
    edges = pages.link_edges(facts(spark, sf))
    return edges.groupBy("site_id", "source", "target", "internal").agg(F.count("*").alias("anchors"))


# robots: the fixture's documents have known groups by the site's length class
K = "length(site_id) % 5"
PARSED = f"""parsed AS (SELECT site_id, g AS group_id, agents, directive, pattern FROM (SELECT DISTINCT site_id FROM page_base) s JOIN (VALUES
  (0, 1, '*', 'disallow', '/'), (0, 1, '*', 'allow', '/en/'), (0, 1, '*', 'disallow', '/en/1'),
  (1, 0, '*', 'disallow', '/fr/'), (1, 1, 'googlebot,otherbot', 'disallow', '/*page=*'), (1, 1, 'googlebot,otherbot', 'allow', '/en/*page'), (1, 0, '', 'noindex', '/old'),
  (2, 1, 'google', 'disallow', '/*.html$'), (2, 0, '', 'sitemap', 'S'), (2, 2, '*', 'disallow', '/'),
  (3, 1, '*', 'disallow', ''), (3, 1, '*', 'disallow', '/fr'), (3, 1, '*', 'allow', '/fr'), (4, 1, 'otherbot', 'disallow', '/')) v(k, g, agents, directive, pattern) ON {K} = v.k)"""


def _robots(spark, sf):
    return robots.parse_robots(load_view(spark, sf, "robots_docs"))


@query(
    "h8_robots_parse",
    with_views("page_base", extra=PARSED)
    + "SELECT site_id, group_id::BIGINT AS group_id, agents, directive, CASE pattern WHEN 'S' THEN site_id || '/sitemap.xml' ELSE pattern END AS pattern FROM parsed",
)
def h8(spark, sf):
    out = _robots(spark, sf)
    return out.select("site_id", "group_id", F.array_join("agents", ",").alias("agents"), "directive", "pattern")


RULES_SQL = f"""rules AS (SELECT site_id, directive, pattern FROM parsed WHERE directive IN ('allow', 'disallow') AND (({K} = 1 AND group_id = 1) OR ({K} = 2 AND group_id = 1) OR {K} IN (0, 3)))"""


@query("h9_rules_for_agent", with_views("page_base", extra=f"{PARSED}, {RULES_SQL}") + "SELECT * FROM rules")
def h9(spark, sf):
    return robots.rules_for_agent(_robots(spark, sf)).drop("line_no")


BLOCKED = """CASE WHEN length(site_id) % 5 = 0 THEN NOT starts_with(pq, '/en/') OR starts_with(pq, '/en/1') WHEN length(site_id) % 5 = 1 THEN contains(pq, 'page=') AND NOT (starts_with(pq, '/en/') AND contains(substr(pq, 5), 'page') AND 8 > 6)
  WHEN length(site_id) % 5 = 2 THEN suffix(pq, '.html') ELSE FALSE END"""
PQ = "regexp_replace(url, '^[a-z]+://[^/]+', '')"


@query(
    "h10_url_blocked",
    with_views("page_base") + f"SELECT site_id, url, {BLOCKED} AS blocked FROM (SELECT site_id, url, {PQ} AS pq FROM page_base) t",
)
def h10(spark, sf):
    targets = load_view(spark, sf, "page_base").select("site_id", "url")
    return robots.blocked(targets, robots.rules_for_agent(_robots(spark, sf)))


DOC_STATE = """docs AS (SELECT site_id, doc_url, CASE WHEN starts_with(xml, '<urlset>') THEN 'not_well_formed' WHEN starts_with(xml, '<feed>') THEN 'unexpected_root:feed' END AS error,
    CASE WHEN starts_with(xml, '<sitemapindex>') THEN 'sitemapindex' ELSE 'urlset' END AS kind, list_transform(regexp_extract_all(xml, '<loc>([^<]*)</loc>', 1), lambda l: trim(replace(l, '&amp;', '&'))) AS locs FROM sitemap_docs),
  raw_locs AS (SELECT site_id, doc_url, unnest(locs) AS loc FROM docs WHERE kind = 'urlset' AND error IS NULL),"""
SITEMAP = (
    DOC_STATE
    + f"""sitemap AS (SELECT site_id, url, count(*) AS n FROM (SELECT site_id, {q.normalized("loc")} AS url FROM raw_locs WHERE loc LIKE 'http%') t GROUP BY ALL),
  sitemap_errors AS (SELECT site_id, doc_url, error FROM docs WHERE error IS NOT NULL UNION ALL SELECT site_id, doc_url, 'location_not_absolute' FROM raw_locs WHERE loc NOT LIKE 'http%')"""
)
SM = with_views("sitemap_docs", extra=SITEMAP)


@query(
    "h11_sitemap_index",
    SM
    + """, tree AS (SELECT d.site_id, d.doc_url, unnest(locs) AS child, kind FROM docs d),
      reached AS (SELECT site_id, doc_url FROM docs WHERE suffix(doc_url, '/sitemap.xml')
        UNION SELECT site_id, site_id || '/' || child FROM tree WHERE suffix(doc_url, '/sitemap.xml')
        UNION SELECT site_id, site_id || child FROM tree WHERE kind = 'sitemapindex' AND starts_with(child, '/'))
    SELECT d.site_id, d.doc_url, d.kind, coalesce(d.error, '') AS error, CASE WHEN d.error IS NULL THEN len(locs) ELSE 0 END::INT AS locations FROM docs d JOIN reached USING (site_id, doc_url)
    UNION ALL SELECT site_id, doc_url, 'child', 'child_not_same_origin', 0 FROM tree WHERE kind = 'sitemapindex' AND child LIKE 'https://elsewhere%'""",
)
def h11(spark, sf):
    documents = load_view(spark, sf, "sitemap_docs")
    roots = documents.filter(F.col("doc_url").endswith("/sitemap.xml"))
    found, errors = sitemaps.reachable_documents(documents, roots)
    kind = F.when(F.col("kind") == "sitemapindex", F.col("kind")).otherwise(F.lit("urlset"))
    counted = found.groupBy("site_id", "doc_url").agg(
        F.max(kind).alias("kind"), F.coalesce(F.max("error"), F.lit("")).alias("error"), F.count("loc").cast("int").alias("locations")
    )
    return counted.unionByName(errors.select("site_id", "doc_url", F.lit("child").alias("kind"), "error", F.lit(0).alias("locations")))


@query(
    "h12_click_depth",
    with_views(
        "graph_edges",
        recursive=True,
        extra="""e AS (SELECT DISTINCT site_id, source, target FROM graph_edges WHERE source <> target),
      walk(site_id, url, depth) AS (SELECT DISTINCT site_id, 'p1', 0 FROM graph_edges UNION SELECT e.site_id, e.target, w.depth + 1 FROM walk w JOIN e ON e.site_id = w.site_id AND e.source = w.url WHERE w.depth < 14)""",
    )
    + """SELECT n.site_id, n.url, coalesce(i.inbound, 0) AS inbound, d.depth::DOUBLE AS depth FROM (SELECT site_id, source AS url FROM graph_edges UNION SELECT site_id, target FROM graph_edges) n
      LEFT JOIN (SELECT site_id, target AS url, count(*) AS inbound FROM e GROUP BY ALL) i USING (site_id, url) LEFT JOIN (SELECT site_id, url, min(depth) AS depth FROM walk GROUP BY ALL) d USING (site_id, url)""",
)
def h12(spark, sf):
    edges = load_view(spark, sf, "graph_edges")
    nodes = edges.select("site_id", F.col("source").alias("url")).union(edges.select("site_id", "target")).distinct()
    links = graph.page_graph(nodes, edges)
    roots = nodes.select("site_id").distinct().withColumn("url", F.lit("p1"))
    depth = graph.click_depth(links, roots).select("site_id", "url", F.col("depth").cast("double").alias("depth"))
    return graph.inbound_counts(nodes, links).join(depth, ["site_id", "url"], "left")


SPELLED = """known AS (SELECT DISTINCT site_id, CASE WHEN contains(url, '?') THEN CASE WHEN suffix(bare, '.html') OR suffix(bare, '/') THEN bare ELSE bare || '/' END
    WHEN suffix(url, '/') THEN url || 'index.html' ELSE url END AS url FROM (SELECT *, regexp_replace(url, '[?].*$', '') AS bare FROM page_base) p WHERE page_id % 4 <> 3),
  wanted AS (SELECT DISTINCT site_id, url || CASE page_id % 4 WHEN 3 THEN '/none' ELSE '' END AS target FROM page_base),
  parts AS (SELECT *, regexp_replace(target, '[?].*$', '') AS bare, regexp_extract(target, '[?].*$', 0) AS qs FROM wanted),
  alts AS (SELECT *, CASE WHEN suffix(bare, '/') THEN bare || 'index.html' WHEN suffix(bare, '/index.html') THEN bare[:-11]
    WHEN NOT contains(regexp_extract(bare, '[^/]*$', 0), '.') THEN bare || '/' END AS alt FROM parts),
  spelled AS (SELECT site_id, target, 1 AS k, target AS url FROM alts UNION ALL SELECT site_id, target, 2, bare FROM alts
    UNION ALL SELECT site_id, target, 3, alt || qs FROM alts UNION ALL SELECT site_id, target, 4, alt FROM alts)"""


@query(
    "h13_route_variants",
    with_views("page_base", extra=SPELLED)
    + """SELECT w.site_id, w.target, arg_min(k.url, s.k) FILTER (k.url IS NOT NULL) AS matched FROM wanted w JOIN spelled s USING (site_id, target)
      LEFT JOIN known k ON k.site_id = s.site_id AND k.url = s.url GROUP BY ALL""",
)
def h13(spark, sf):
    """Wanted page URLs against build files spelled differently: index files, slashes, no query."""
    base = load_view(spark, sf, "page_base").withColumn("bare", F.regexp_replace("url", r"\?.*$", ""))
    spelled = F.when(
        F.instr("url", "?") > 0,
        F.when(F.col("bare").rlike(r"(\.html|/)$"), F.col("bare")).otherwise(F.concat("bare", F.lit("/"))),
    ).when(F.col("url").endswith("/"), F.concat("url", F.lit("index.html"))).otherwise(F.col("url"))
    known = base.filter("page_id % 4 <> 3").select("site_id", spelled.alias("url"))
    suffix = F.when(F.col("page_id") % 4 == 3, F.lit("/none")).otherwise(F.lit(""))
    return graph.match_routes(base.select("site_id", F.concat("url", suffix).alias("target")), known)


SIGNALS = ("titles", "descriptions", "canonicals", "robots", "internal_links")
COMPARE = with_views("site_pages", "rendered_pages", extra=f"{FACTS}, {RENDERED}")


@query(
    "h14_rendering_comparison",
    COMPARE
    + "SELECT coalesce(s.site_id, r.site_id) AS site_id, coalesce(s.url, r.url) AS url, CASE WHEN s.url IS NULL THEN 'rendered_only' WHEN r.url IS NULL THEN 'source_only' ELSE 'matched' END AS presence, "
    + ", ".join(f"s.{c} IS DISTINCT FROM r.{c} AS {c}_changed" for c in (*SIGNALS, "html_sha256"))
    + " FROM facts s FULL JOIN rendered r ON s.site_id = r.site_id AND s.url = r.url",
)
def h14(spark, sf):
    out = pages.rendering_comparison(facts(spark, sf), rendered(spark, sf))
    return out.select("site_id", "url", "presence", *[f"{c}_changed" for c in (*SIGNALS, "html_sha256")])


@query(
    "h15_duplicate_values",
    BASE
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, site_id, url, key, members FROM (SELECT site_id, url, lower({c}[1]) AS key, count(*) OVER (PARTITION BY site_id, lower({c}[1])) AS members FROM facts WHERE {c}[1] <> '') t WHERE members > 1"
        for c in ("titles", "descriptions")
    ),
)
def h15(spark, sf):
    f = facts(spark, sf)
    parts = [rules.duplicate_values(f, c).withColumn("field", F.lit(c)) for c in ("titles", "descriptions")]
    return parts[0].unionByName(parts[1])


DECLARED = """SELECT url, CASE page_id % 10 WHEN 1 THEN 'xyz' WHEN 2 THEN sha256('other') ELSE sha256(html) END AS sha256 FROM {0} WHERE page_id % 10 <> 3
  UNION ALL SELECT url, sha256(html) FROM {0} WHERE page_id % 10 = 4"""


@query(
    "h16_provenance",
    BASE
    + f""", declared AS ({DECLARED.format("site_pages")}), per AS (SELECT {q.normalized(q.crawl("url"))} AS url, count(*) AS n, min(sha256) AS d FROM declared GROUP BY ALL)
    SELECT * FROM (SELECT f.site_id, f.url, CASE WHEN n IS NULL THEN 'not_declared' WHEN n > 1 THEN 'declared_twice' WHEN length(d) <> 64 THEN 'digest_malformed' WHEN d <> f.html_sha256 THEN 'digest_mismatch' END AS issue
      FROM facts f LEFT JOIN per p ON f.url = p.url) t WHERE issue IS NOT NULL""",
)
def h16(spark, sf):
    source = load_pages(spark, sf, "site_pages")
    k = F.col("page_id") % 10
    digest = F.when(k == 1, F.lit("xyz")).when(k == 2, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("html", 256))
    shown = source.withColumn("sha256", digest).select("url", "sha256", k.alias("k"))
    declared = shown.filter("k <> 3").unionByName(shown.filter("k = 4")).drop("k")
    return pages.provenance_issues(facts(spark, sf), declared)


@query(
    "h17_redirect_chains",
    with_views(
        "redirects",
        recursive=True,
        extra="""w(url, at_url, path, hops, state) AS (
      SELECT url, location, [url, location], 1, CASE WHEN url = location THEN 'loop' ELSE 'open' END FROM redirects
      UNION ALL SELECT w.url, r.location, list_append(w.path, r.location), w.hops + 1, CASE WHEN list_contains(w.path, r.location) THEN 'loop' ELSE 'open' END
        FROM w JOIN redirects r ON r.url = w.at_url WHERE w.state = 'open')""",
    )
    + """SELECT url, at_url AS final_url, hops::INT AS hops, CASE WHEN state = 'loop' THEN 'loop' WHEN hops > 10 THEN 'too_long' ELSE 'resolved' END AS state
    FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY hops DESC) AS k FROM w) t WHERE k = 1""",
)
def h17(spark, sf):
    return graph.resolve_redirects(load_view(spark, sf, "redirects"))
