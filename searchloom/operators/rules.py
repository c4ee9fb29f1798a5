"""Site findings. Every rule is one DataFrame over the shared page facts, and all have the same columns.

A finding row is ``site_id, code, severity, category, url, evidence``. Rules about one page give one row
per page; rules about a set of pages (repeated titles, orphans) give one row per member, so a group of
any size stays spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.functions import urls
from searchloom.operators import graph, pages, robots
from searchloom.operators.robots import CRAWLER

# Severities in order, finding groups by code prefix and by category.
SEVERITIES = ("critical", "high", "medium", "low", "info")
GROUP_PREFIXES = (
    ("access", "^(?i)(?:http|robots|indexing|sitemap)\\."),
    ("page-signals", "^(?i)(?:canonical|metadata|language)\\."),
    ("content", "^(?i)(?:headings|structured-data|images)\\."),
    ("discovery", "^(?i)links\\."),
)
GROUP_CATEGORIES = {
    "http": "access",
    "crawl-control": "access",
    "indexing": "access",
    "metadata": "page-signals",
    "url-signals": "page-signals",
    "international": "page-signals",
    "content-structure": "content",
    "structured-data": "content",
    "images": "content",
    "internal-links": "discovery",
}


@dataclass
class Site:
    """Inputs of the rules; tables a check does not need may be None.

    ``static`` says the pages are build files (no HTTP evidence); ``sites`` has ``site_id, production``.
    """

    facts: DataFrame
    sites: DataFrame
    fetches: DataFrame | None = None
    sitemap: DataFrame | None = None
    sitemap_errors: DataFrame | None = None
    robots: DataFrame | None = None
    assets: DataFrame | None = None
    rendered: DataFrame | None = None
    static: bool = False
    agent: str = CRAWLER


RULES: dict[str, Callable[[Site], DataFrame]] = {}


def rule(code: str) -> Callable[[Callable[[Site], DataFrame]], Callable[[Site], DataFrame]]:
    def add(fn: Callable[[Site], DataFrame]) -> Callable[[Site], DataFrame]:
        RULES[code] = fn
        return fn

    return add


def _finding(rows: DataFrame, code: str, severity: str | Column, category: str, url: str | Column = "url", evidence: Column | None = None) -> DataFrame:
    return rows.select(
        "site_id",
        F.lit(code).alias("code"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(category).alias("category"),
        (F.col(url) if isinstance(url, str) else url).alias("url"),
        (F.lit("") if evidence is None else F.coalesce(evidence, F.lit(""))).alias("evidence"),
    )


def _filled(values: str) -> Column:
    return F.exists(values, lambda v: v != "")


def _listed(values: Column) -> Column:
    return F.array_join(values, ", ")


def _grave(site: Site, rows: DataFrame) -> DataFrame:
    return rows.join(site.sites, "site_id", "left")


def _critical() -> Column:
    return F.when(F.coalesce("production", F.lit(False)), F.lit("critical")).otherwise(F.lit("high"))


@rule("scope.no-html")
def scope_no_html(s: Site) -> DataFrame:
    empty = s.sites.join(s.facts.select("site_id").distinct(), "site_id", "left_anti")
    return _finding(empty, "scope.no-html", "high", "scope", F.col("site_id"))


@rule("sitemap.parse-error")
def sitemap_parse_error(s: Site) -> DataFrame:
    return _finding(s.sitemap_errors, "sitemap.parse-error", "high", "sitemap", "doc_url", F.col("error"))


@rule("sitemap.duplicate-url")
def sitemap_duplicate_url(s: Site) -> DataFrame:
    return _finding(s.sitemap.filter("n > 1"), "sitemap.duplicate-url", "medium", "sitemap")


@rule("http.server-error")
def http_server_error(s: Site) -> DataFrame:
    bad = _grave(s, s.facts.filter("status >= 500"))
    return _finding(bad, "http.server-error", _critical(), "crawlability", evidence=F.col("requested_url"))


@rule("http.client-error")
def http_client_error(s: Site) -> DataFrame:
    bad = s.facts.filter("status BETWEEN 400 AND 499")
    return _finding(bad, "http.client-error", "high", "crawlability", evidence=F.col("requested_url"))


def _redirected(s: Site) -> DataFrame:
    moved = urls.normalized(F.col("requested_url")) != urls.normalized(F.col("final_url"))
    return s.facts.filter(moved)


@rule("http.redirect-observed")
def http_redirect_observed(s: Site) -> DataFrame:
    arrow = F.concat_ws(" -> ", "requested_url", "final_url")
    return _finding(_redirected(s), "http.redirect-observed", "info", "url-signals", "requested_url", arrow)


@rule("http.redirect-chain")
def http_redirect_chain(s: Site) -> DataFrame:
    long = _redirected(s).filter("redirect_hops > 1")
    return _finding(long, "http.redirect-chain", "medium", "url-signals", "requested_url", F.col("redirect_hops").cast("string"))


@rule("metadata.title-missing")
def title_missing(s: Site) -> DataFrame:
    bad = s.facts.filter(~_filled("titles"))
    count = F.concat(F.lit("title_count="), F.size("titles").cast("string"))
    return _finding(bad, "metadata.title-missing", "high", "search-presentation", evidence=count)


@rule("metadata.multiple-title")
def multiple_title(s: Site) -> DataFrame:
    bad = s.facts.filter(_filled("titles") & (F.size("titles") > 1))
    return _finding(bad, "metadata.multiple-title", "medium", "search-presentation", evidence=_listed(F.col("titles")))


@rule("metadata.description-missing")
def description_missing(s: Site) -> DataFrame:
    count = F.concat(F.lit("description_count="), F.size("descriptions").cast("string"))
    bad = s.facts.filter(~_filled("descriptions"))
    return _finding(bad, "metadata.description-missing", "low", "search-presentation", evidence=count)


@rule("canonical.multiple")
def canonical_multiple(s: Site) -> DataFrame:
    bad = s.facts.filter(F.size("canonicals") > 1)
    return _finding(bad, "canonical.multiple", "high", "url-signals", evidence=_listed(F.col("canonicals")))


@rule("canonical.not-explicit")
def canonical_not_explicit(s: Site) -> DataFrame:
    return _finding(s.facts.filter(F.size("canonicals") == 0), "canonical.not-explicit", "info", "url-signals")


def _single_canonical(s: Site) -> DataFrame:
    return s.facts.filter(F.size("canonicals") == 1).withColumn("canonical", F.element_at("canonicals", 1))


@rule("canonical.invalid")
def canonical_invalid(s: Site) -> DataFrame:
    bad = _single_canonical(s).filter(~urls.is_http(F.col("canonical")))
    return _finding(bad, "canonical.invalid", "high", "url-signals", evidence=F.col("canonical"))


def _known_targets(s: Site) -> DataFrame:
    """Pages, assets and fetched URLs; a canonical or link may point at any of them."""
    parts = [s.facts.select("site_id", "url")]
    parts += [t.select("site_id", "url") for t in (s.assets, s.fetches) if t is not None]
    return reduce(DataFrame.unionByName, parts).distinct()


def _unmatched_routes(s: Site, wanted: DataFrame) -> DataFrame:
    """Wanted ``target`` URLs for which no route spelling is known."""
    return graph.match_routes(wanted, _known_targets(s)).filter("matched IS NULL").select("site_id", "target")


@rule("canonical.target-outside-artifact")
def canonical_outside(s: Site) -> DataFrame:
    single = _single_canonical(s).withColumn("target", F.col("canonical"))
    missing = _unmatched_routes(s, single) if s.static else None
    rows = single.limit(0) if missing is None else single.join(missing, ["site_id", "target"], "left_semi")
    return _finding(rows, "canonical.target-outside-artifact", "medium", "url-signals", evidence=F.col("canonical"))


@rule("canonical.target-error")
def canonical_target_error(s: Site) -> DataFrame:
    tried = s.fetches.select("site_id", F.col("url").alias("canonical"), F.col("status").alias("target_status"))
    bad = _single_canonical(s).join(tried, ["site_id", "canonical"]).filter("target_status IS NULL OR target_status >= 400")
    shown = F.concat(F.col("canonical"), F.lit(" HTTP "), F.coalesce(F.col("target_status").cast("string"), F.lit("unknown")))
    return _finding(bad, "canonical.target-error", "high", "url-signals", evidence=shown)


@rule("robots.noindex")
def robots_noindex(s: Site) -> DataFrame:
    whole = s.facts.groupBy("site_id").agg(F.bool_and("noindex").alias("_all"))
    bad = _grave(s, s.facts.filter("noindex")).join(whole, "site_id")
    level = F.when(F.coalesce("production", F.lit(False)) & F.col("_all"), F.lit("critical")).otherwise(F.lit("high"))
    return _finding(bad, "robots.noindex", level, "indexability", evidence=_listed(F.col("robots")))


@rule("signals.noindex-cross-canonical")
def noindex_cross_canonical(s: Site) -> DataFrame:
    first = F.try_element_at("canonicals", F.lit(1))
    bad = s.facts.filter(F.col("noindex") & (first != F.col("url")))
    return _finding(bad, "signals.noindex-cross-canonical", "high", "url-signals", evidence=first)


@rule("structured-data.invalid-json")
def invalid_json(s: Site) -> DataFrame:
    bad = s.facts.filter(F.size("json_ld_errors") > 0)
    count = F.concat(F.lit("blocks="), F.size("json_ld_errors").cast("string"))
    return _finding(bad, "structured-data.invalid-json", "medium", "structured-data", evidence=count)


@rule("images.alt-attribute-missing")
def alt_missing(s: Site) -> DataFrame:
    bare = F.transform(F.filter("images", lambda i: ~i["alt_present"]), lambda i: i["src"])
    bad = s.facts.withColumn("_bare", bare).filter(F.size("_bare") > 0)
    return _finding(bad, "images.alt-attribute-missing", "low", "images-accessibility", evidence=_listed(F.col("_bare")))


def _per_source(pairs: DataFrame, code: str, severity: str, category: str) -> DataFrame:
    """One finding per source page; its targets are bounded by that one document's links."""
    grouped = pairs.groupBy("site_id", F.col("source").alias("url")).agg(F.array_sort(F.collect_set("target")).alias("t"))
    return _finding(grouped, code, severity, category, evidence=_listed(F.col("t")))


@rule("images.missing-local-asset")
def missing_local_asset(s: Site) -> DataFrame:
    used = s.facts.select("site_id", F.col("url").alias("source"), F.explode("image_resources.url").alias("target"))
    own = used.filter(urls.origin(F.col("target")) == F.col("site_id"))
    absent = graph.match_assets(own, s.assets).filter("matched IS NULL").select("site_id", "target")
    lost = own.join(absent, ["site_id", "target"], "left_semi") if s.static else own.limit(0)
    return _per_source(lost, "images.missing-local-asset", "medium", "images-accessibility")


@rule("language.html-lang-missing")
def lang_missing(s: Site) -> DataFrame:
    bad = s.facts.filter((F.size("hreflang") > 0) & (F.col("html_lang") == ""))
    return _finding(bad, "language.html-lang-missing", "low", "international")


@rule("links.non-crawlable-control")
def non_crawlable_control(s: Site) -> DataFrame:
    bad = s.facts.filter((F.size("anchors_without_href") > 0) | (F.size("link_controls") > 0))
    shown = F.concat(
        F.lit("anchors="), F.size("anchors_without_href").cast("string"), F.lit("; controls="), F.size("link_controls").cast("string")
    )
    return _finding(bad, "links.non-crawlable-control", "medium", "discovery", evidence=shown)


def _pairs(s: Site) -> DataFrame:
    return pages.rendering_comparison(s.facts, s.rendered).filter("presence = 'matched'")


@rule("rendering.initial-noindex-removed")
def noindex_removed(s: Site) -> DataFrame:
    bad = _pairs(s).filter("source_noindex AND NOT rendered_noindex")
    return _finding(bad, "rendering.initial-noindex-removed", "high", "javascript-rendering")


@rule("rendering.canonical-changed")
def canonical_changed(s: Site) -> DataFrame:
    bad = _pairs(s).filter("canonicals_changed")
    both = (F.size("source_canonicals") > 0) & (F.size("rendered_canonicals") > 0)
    level = F.when(both, F.lit("high")).otherwise(F.lit("medium"))
    shown = F.concat(_listed(F.col("source_canonicals")), F.lit(" => "), _listed(F.col("rendered_canonicals")))
    return _finding(bad, "rendering.canonical-changed", level, "javascript-rendering", evidence=shown)


@rule("rendering.content-client-only")
def content_client_only(s: Site) -> DataFrame:
    bad = _pairs(s).filter("source_visible_text_length = 0 AND rendered_visible_text_length > 0")
    return _finding(bad, "rendering.content-client-only", "medium", "javascript-rendering")


@rule("rendering.links-client-added")
def links_client_added(s: Site) -> DataFrame:
    added = F.array_except("rendered_internal_links", "source_internal_links")
    bad = _pairs(s).withColumn("_added", added).filter(F.size("_added") > 0)
    count = F.concat(F.lit("client_added_links="), F.size("_added").cast("string"))
    return _finding(bad, "rendering.links-client-added", "medium", "javascript-rendering", evidence=count)


def duplicate_values(facts: DataFrame, field: str) -> DataFrame:
    """Members of each group of pages sharing a first title or description, with the group size.

    Group sizes come from a map-side combined count; joining them back gives a skewed group's rows to
    many tasks, and no list of all members is ever built.
    """
    first = F.try_element_at(F.col(field), F.lit(1))
    keyed = facts.select("site_id", "url", F.lower(pages.one_line(first)).alias("key")).filter("key <> ''")
    sizes = keyed.groupBy("site_id", "key").agg(F.count("*").alias("members")).filter("members > 1")
    return keyed.join(sizes, ["site_id", "key"])


def _duplicates(s: Site, field: str, code: str, severity: str) -> DataFrame:
    return _finding(duplicate_values(s.facts, field), code, severity, "search-presentation", evidence=F.col("key"))


@rule("metadata.duplicate-title")
def duplicate_title(s: Site) -> DataFrame:
    return _duplicates(s, "titles", "metadata.duplicate-title", "medium")


@rule("metadata.duplicate-description")
def duplicate_description(s: Site) -> DataFrame:
    return _duplicates(s, "descriptions", "metadata.duplicate-description", "low")


@rule("links.broken-internal")
def broken_internal(s: Site) -> DataFrame:
    edges = pages.internal_targets(s.facts).withColumn("target", urls.normalized(F.col("target"))).distinct()
    keys = ["site_id", "target"]
    tried = s.fetches.filter("status IS NULL OR status >= 400").select("site_id", F.col("url").alias("target"))
    failing = edges.join(tried, keys, "left_semi")
    if s.static:
        failing = failing.unionByName(edges.join(_unmatched_routes(s, edges), keys, "left_semi")).distinct()
    return _per_source(failing, "links.broken-internal", "high", "discovery")


@rule("links.parameter-url-observed")
def parameter_url(s: Site) -> DataFrame:
    edges = pages.internal_targets(s.facts).withColumn("target", urls.normalized(F.col("target")))
    return _per_source(edges.filter(F.instr("target", "?") > 0), "links.parameter-url-observed", "info", "url-signals")


@rule("links.orphan-in-scope")
def orphan(s: Site) -> DataFrame:
    linked = graph.inbound_counts(s.facts, graph.page_graph(s.facts, pages.internal_targets(s.facts)))
    listed = s.sitemap.select("site_id", "url", F.lit(True).alias("listed"))
    lost = linked.filter((F.col("inbound") == 0) & (F.col("url") != F.concat("site_id", F.lit("/")))).join(
        listed, ["site_id", "url"], "left"
    )
    level = F.when(F.col("listed"), F.lit("medium")).otherwise(F.lit("low"))
    return _finding(lost, "links.orphan-in-scope", level, "discovery")


def _alternates(s: Site) -> DataFrame:
    return s.facts.select("site_id", "url", F.explode("hreflang").alias("h")).select(
        "site_id", "url", F.col("h.lang").alias("lang"), F.col("h.url").alias("target")
    )


@rule("hreflang.duplicate-language")
def duplicate_language(s: Site) -> DataFrame:
    grouped = _alternates(s).groupBy("site_id", "url", F.lower("lang").alias("lang")).agg(
        F.array_sort(F.collect_set("target")).alias("t")
    )
    bad = grouped.filter(F.size("t") > 1)
    return _finding(bad, "hreflang.duplicate-language", "high", "international", evidence=_listed(F.col("t")))


@rule("hreflang.self-reference-missing")
def self_reference_missing(s: Site) -> DataFrame:
    bad = s.facts.filter((F.size("hreflang") > 0) & ~F.array_contains(F.col("hreflang.url"), F.col("url")))
    count = F.concat(F.lit("targets="), F.size("hreflang").cast("string"))
    return _finding(bad, "hreflang.self-reference-missing", "medium", "international", evidence=count)


def _alternate_pairs(s: Site) -> DataFrame:
    """Alternates whose target is a known page, with that page's noindex flag."""
    target = s.facts.select("site_id", F.col("url").alias("target"), F.col("noindex").alias("target_noindex"))
    return _alternates(s).join(target, ["site_id", "target"])


@rule("hreflang.return-link-missing")
def return_link_missing(s: Site) -> DataFrame:
    back = _alternates(s).select("site_id", F.col("url").alias("target"), F.col("target").alias("url")).distinct()
    bad = _alternate_pairs(s).join(back, ["site_id", "url", "target"], "left_anti")
    shown = F.concat_ws(" -> ", "url", "lang", "target")
    return _finding(bad, "hreflang.return-link-missing", "medium", "international", evidence=shown)


@rule("hreflang.target-noindex")
def target_noindex(s: Site) -> DataFrame:
    bad = _alternate_pairs(s).filter("target_noindex")
    return _finding(bad, "hreflang.target-noindex", "high", "international", evidence=F.concat_ws(" -> ", "lang", "target"))


@rule("sitemap.cross-origin-url")
def sitemap_cross_origin(s: Site) -> DataFrame:
    bad = s.sitemap.filter(urls.origin(F.col("url")) != F.col("site_id"))
    return _finding(bad, "sitemap.cross-origin-url", "medium", "sitemap")


def _listed_pages(s: Site) -> DataFrame:
    return s.facts.join(s.sitemap.select("site_id", "url"), ["site_id", "url"], "left_semi")


@rule("sitemap.noindex-url")
def sitemap_noindex(s: Site) -> DataFrame:
    bad = _listed_pages(s).filter("noindex")
    return _finding(bad, "sitemap.noindex-url", "high", "url-signals", evidence=_listed(F.col("robots")))


@rule("sitemap.noncanonical-url")
def sitemap_noncanonical(s: Site) -> DataFrame:
    first = F.try_element_at("canonicals", F.lit(1))
    bad = _listed_pages(s).filter(first != F.col("url"))
    return _finding(bad, "sitemap.noncanonical-url", "high", "url-signals", evidence=first)


@rule("sitemap.url-missing-artifact")
def sitemap_missing_artifact(s: Site) -> DataFrame:
    lost = s.sitemap.join(s.facts.select("site_id", "url"), ["site_id", "url"], "left_anti") if s.static else s.sitemap.limit(0)
    return _finding(lost, "sitemap.url-missing-artifact", "medium", "sitemap")


@rule("robots.unsupported-noindex")
def unsupported_noindex(s: Site) -> DataFrame:
    lines = s.robots.filter("directive = 'noindex'").groupBy("site_id").agg(F.array_sort(F.collect_list("pattern")).alias("p"))
    return _finding(lines, "robots.unsupported-noindex", "medium", "indexability", F.col("site_id"), _listed(F.col("p")))


def _blocked_roots(s: Site, rules: DataFrame) -> DataFrame:
    roots = s.sites.select("site_id", "production", F.concat("site_id", F.lit("/")).alias("url"))
    return robots.blocked(roots, rules).filter("blocked")


@rule("robots.sitewide-block")
def sitewide_block(s: Site) -> DataFrame:
    bad = _blocked_roots(s, robots.rules_for_agent(s.robots))
    return _finding(bad, "robots.sitewide-block", _critical(), "crawlability")


@rule("robots.blocks-sitemap-url")
def blocks_sitemap_url(s: Site) -> DataFrame:
    bad = robots.blocked(s.sitemap.select("site_id", "url"), robots.rules_for_agent(s.robots)).filter("blocked")
    return _finding(bad, "robots.blocks-sitemap-url", "high", "url-signals")


@rule("structured-data.website-multi-page")
def website_multi_page(s: Site) -> DataFrame:
    rows = s.facts.filter(F.array_contains("json_ld_types", "WebSite")).select("site_id", "url")
    many = rows.groupBy("site_id").agg(F.count("*").alias("n")).filter("n > 1")
    shown = F.concat(F.lit("pages="), F.col("n").cast("string"))
    return _finding(rows.join(many, "site_id"), "structured-data.website-multi-page", "info", "structured-data", evidence=shown)


def _healthy(s: Site) -> DataFrame:
    return s.facts.filter("status BETWEEN 200 AND 399")


@rule("canonical.missing")
def canonical_missing(s: Site) -> DataFrame:
    return _finding(_healthy(s).filter(F.size("canonicals") == 0), "canonical.missing", "medium", "url-signals")


@rule("canonical.cross-origin")
def canonical_cross_origin(s: Site) -> DataFrame:
    one = F.element_at("canonicals", 1)
    bad = _healthy(s).filter(F.size("canonicals") == 1).filter(urls.origin(one) != F.col("site_id"))
    return _finding(bad, "canonical.cross-origin", "medium", "url-signals", evidence=one)


@rule("headings.h1-missing")
def h1_missing(s: Site) -> DataFrame:
    return _finding(_healthy(s).filter("h1_count = 0"), "headings.h1-missing", "medium", "content-structure")


@rule("robots.blocks-start-url")
def blocks_start_url(s: Site) -> DataFrame:
    bad = _blocked_roots(s, robots.rules_for_agent(s.robots, s.agent, longest_token=True))
    return _finding(bad, "robots.blocks-start-url", _critical(), "crawl-control")


@rule("links.internal-http-error")
def internal_http_error(s: Site) -> DataFrame:
    broken = s.facts.filter("status >= 400").select(
        "site_id", F.col("url").alias("target"), F.col("status").alias("target_status")
    )
    edges = pages.internal_targets(_healthy(s)).join(broken, ["site_id", "target"])
    shown = F.concat(F.col("target"), F.lit(" status="), F.col("target_status").cast("string"))
    return _finding(edges, "links.internal-http-error", "high", "internal-links", "source", shown)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in SEVERITIES]), severity) - 1


def inspect_site(s: Site, codes: list[str] | None = None) -> DataFrame:
    """Union of the chosen rules (all by default) over the same facts."""
    parts = [RULES[c](s) for c in (codes or list(RULES))]
    return reduce(DataFrame.unionByName, parts)


def ordered(findings: DataFrame) -> DataFrame:
    """Severity, then code, then URL: a range-partitioned sort."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "severity_rank", "code", "url", "site_id"
    )


def fails_at(findings: DataFrame, threshold: str) -> DataFrame:
    """Per site: whether any finding reaches the threshold severity."""
    limit = SEVERITIES.index(threshold)
    hit = F.bool_or(severity_rank(F.col("severity")) <= limit)
    return findings.groupBy("site_id").agg(hit.alias("fails"))


def site_summary(s: Site, findings: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """Counts per site: pages, statuses, noindex, orphans, reach and findings per severity."""
    status = F.floor(F.col("status") / 100)
    base = s.facts.groupBy("site_id").agg(
        F.count("*").alias("pages"),
        F.count_if("noindex").alias("noindex_pages"),
        *[F.count_if(status == k).alias(f"status_{k}xx") for k in (2, 3, 4, 5)],
        F.count_if(F.col("status").isNull()).alias("status_unknown"),
    )
    per = findings.groupBy("site_id").agg(
        *[F.count_if(F.col("severity") == v).alias(v) for v in SEVERITIES],
        F.count_if(F.col("code") == "links.orphan-in-scope").alias("orphan_pages"),
    )
    out = base.join(per, "site_id", "left")
    if depths is not None:
        reach = depths.groupBy("site_id").agg(F.count("*").alias("reachable_pages"), F.max("depth").alias("max_depth"))
        out = out.join(reach, "site_id", "left")
    # counts are zero without a finding; an unknown depth or reach stays NULL
    return out.fillna(0, [c for c in out.columns if c not in ("max_depth", "reachable_pages")])


def finding_group(code: Column, category: Column) -> Column:
    picked = F.when(F.lit(False), F.lit(""))
    for name, prefix in GROUP_PREFIXES:
        picked = picked.when(code.rlike(prefix), F.lit(name))
    by_category = F.create_map(*[F.lit(x) for pair in GROUP_CATEGORIES.items() for x in pair])
    return picked.otherwise(F.coalesce(F.try_element_at(by_category, category), F.lit("other")))


def group_counts(findings: DataFrame) -> DataFrame:
    grouped = findings.withColumn("group", finding_group(F.col("code"), F.col("category")))
    return grouped.groupBy("site_id", "group").pivot("severity", list(SEVERITIES)).count().fillna(0)
