"""Page facts: what one HTML document says about itself, as a flat table for all checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.functions import urls
from searchloom.functions.html_tokens import FACT_DDL, read_batches

# Robots directives that carry a value, and crawler scopes that count.
VALUE_DIRECTIVES = ("max-image-preview", "max-snippet", "max-video-preview", "unavailable_after")
SCOPES = ("googlebot",)


def read_elements(pages: DataFrame) -> DataFrame:
    """Parse ``html`` in Arrow batches, which Spark limits by bytes, so large documents do not pile up in a worker."""
    hashed = pages.withColumn("html_sha256", F.sha2("html", 256))
    kept = T.StructType([f for f in hashed.schema.fields if f.name != "html"])
    schema = T.StructType(kept.fields + T.StructType.fromDDL(FACT_DDL).fields)
    return hashed.mapInArrow(read_batches, schema)


def _pick(tag: str) -> Column:
    return F.filter("elements", lambda e: e["tag"] == tag)


def _attr(element: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(element["attrs"], F.lit(name)), F.lit(""))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _has_rel(element: Column, token: str) -> Column:
    return F.array_contains(F.split(F.lower(F.trim(_attr(element, "rel"))), r"\s+"), token)


def directive_tokens(values: Column) -> Column:
    """Index directives that apply: unscoped ones and those scoped to the search crawler.

    A scope such as ``googlebot:`` holds until the next scope in the same value; ``none`` means both
    noindex and nofollow.
    """

    def of_value(value: Column) -> Column:
        items = F.filter(
            F.transform(F.split(F.lower(value), "[,;]"), lambda i: F.trim(i)), lambda i: i != ""
        )
        start = F.struct(F.lit("").alias("scope"), F.array().cast("array<string>").alias("found"))

        def step(state: Column, item: Column) -> Column:
            prefix = F.trim(F.substring_index(item, ":", 1))
            scoped = item.contains(":") & prefix.rlike("^[a-z0-9_-]+$") & ~prefix.isin(*VALUE_DIRECTIVES)
            scope = F.when(scoped, prefix).otherwise(state["scope"])
            body = F.when(scoped, F.trim(F.regexp_replace(item, "^[^:]*:", ""))).otherwise(item)
            token = F.trim(F.substring_index(body, ":", 1))
            applies = (token != "") & ((scope == "") | scope.isin(*SCOPES))
            return F.struct(
                scope.alias("scope"),
                F.when(applies, F.array_append(state["found"], token)).otherwise(state["found"]).alias("found"),
            )

        return F.aggregate(items, start, step, lambda s: s["found"])

    tokens = F.flatten(F.transform(values, of_value))
    both = F.when(F.array_contains(tokens, "none"), F.array(F.lit("noindex"), F.lit("nofollow"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_sort(F.array_distinct(F.concat(tokens, both)))


def page_facts(pages: DataFrame) -> DataFrame:
    """One row per page: ``site_id`` (its origin), ``url`` and everything the rules ask for.

    Input: ``site_id, url, html, status, requested_url, final_url, redirect_hops, x_robots_tag`` and any
    further columns, which are kept.
    """
    read = read_elements(pages)
    meta = lambda *names: F.filter(_pick("meta"), lambda e: F.lower(F.trim(_attr(e, "name"))).isin(*names))
    link = _pick("link")
    anchors = _pick("a")
    web = F.filter(anchors, lambda e: F.coalesce(urls.is_http(e["target"]), F.lit(False)))
    staged = read.select(
        *[c for c in read.columns if c not in ("elements", "resources", "url")],
        urls.normalized(F.col("url")).alias("url"),
        F.transform(_pick("title"), lambda e: e["text"]).alias("titles"),
        F.transform(meta("description"), lambda e: one_line(_attr(e, "content"))).alias("descriptions"),
        F.concat(
            F.transform(meta("robots", "googlebot"), lambda e: _attr(e, "content")),
            F.filter(F.coalesce("x_robots_tag", F.array().cast("array<string>")), lambda v: v != ""),
        ).alias("robots"),
        F.array_sort(
            F.array_distinct(
                F.transform(
                    F.filter(link, lambda e: _has_rel(e, "canonical") & e["target"].isNotNull()),
                    lambda e: urls.normalized(urls.crawl_form(e["target"])),
                )
            )
        ).alias("canonicals"),
        F.transform(
            F.filter(
                link,
                lambda e: _has_rel(e, "alternate") & (F.trim(_attr(e, "hreflang")) != "") & e["target"].isNotNull(),
            ),
            lambda e: F.struct(
                F.trim(_attr(e, "hreflang")).alias("lang"), urls.normalized(urls.crawl_form(e["target"])).alias("url")
            ),
        ).alias("hreflang"),
        F.transform(
            web,
            lambda e: F.struct(
                urls.crawl_form(e["target"]).alias("target"),
                e["text"].alias("anchor"),
                F.array_sort(
                    F.array_distinct(
                        F.filter(F.split(F.lower(_attr(e, "rel")), r"\s+"), lambda t: t != "")
                    )
                ).alias("rel"),
            ),
        ).alias("links"),
        F.transform(
            _pick("img"),
            lambda e: F.struct(
                F.trim(_attr(e, "src")).alias("src"),
                F.map_contains_key(e["attrs"], "alt").alias("alt_present"),
                (F.trim(_attr(e, "width")) != "").alias("width_present"),
                (F.trim(_attr(e, "height")) != "").alias("height_present"),
            ),
        ).alias("images"),
        F.array_distinct(
            F.transform(
                F.filter("resources", lambda r: urls.is_http(r["target"])),
                lambda r: F.struct(
                    r["element"].alias("element"),
                    r["attribute"].alias("attribute"),
                    urls.normalized(urls.crawl_form(r["target"])).alias("url"),
                ),
            )
        ).alias("image_resources"),
        F.trim(F.coalesce(F.try_element_at(F.transform(_pick("html"), lambda e: _attr(e, "lang")), F.lit(1)), F.lit(""))).alias(
            "html_lang"
        ),
        F.transform(
            F.filter("elements", lambda e: e["tag"].rlike("^h[1-6]$")),
            lambda e: F.struct(F.substring(e["tag"], 2, 1).cast("int").alias("level"), e["text"].alias("text")),
        ).alias("headings"),
        F.size(_pick("main")).alias("main_count"),
        F.size(anchors).alias("anchor_count"),
        F.transform(
            F.filter(anchors, lambda e: F.trim(_attr(e, "href")) == ""), lambda e: e["text"]
        ).alias("anchors_without_href"),
        F.transform(_pick("role-link"), lambda e: _attr(e, "tag")).alias("link_controls"),
        F.sha2("visible_text", 256).alias("visible_text_sha256"),
        F.length("visible_text").alias("visible_text_length"),
    ).drop("visible_text")
    return staged.select(
        "*",
        F.size(F.filter("headings", lambda h: h["level"] == 1)).alias("h1_count"),
        F.array_contains(directive_tokens(F.col("robots")), "noindex").alias("noindex"),
    )


def link_edges(facts: DataFrame) -> DataFrame:
    """One row per anchor with its target, text and rel; ``internal`` compares origins."""
    rows = facts.select("site_id", F.col("url").alias("source"), F.explode("links").alias("l"))
    flat = rows.select("site_id", "source", "l.target", "l.anchor", "l.rel")
    return flat.withColumn("internal", urls.origin(F.col("target")) == F.col("site_id"))


def internal_targets(facts: DataFrame) -> DataFrame:
    """Distinct ``(site_id, source, target)`` of links inside the site."""
    return link_edges(facts).filter("internal").select("site_id", "source", "target").distinct()


def rendering_comparison(source: DataFrame, rendered: DataFrame) -> DataFrame:
    """Full outer pairing by URL with one changed-flag per signal."""
    signals = (
        "titles", "descriptions", "canonicals", "robots", "internal_links", "json_ld_types",
        "visible_text_sha256", "visible_text_length", "h1_count", "main_count",
    )

    def side(facts: DataFrame, prefix: str) -> DataFrame:
        inner = F.filter("links", lambda l: urls.origin(l["target"]) == F.col("site_id"))  # noqa: E741
        with_links = facts.withColumn(
            "internal_links", F.array_sort(F.array_distinct(F.transform(inner, lambda l: l["target"])))  # noqa: E741
        )
        return with_links.select(
            "site_id", "url", *[F.col(c).alias(f"{prefix}_{c}") for c in (*signals, "html_sha256", "noindex")],
            F.lit(True).alias(f"in_{prefix}"),
        )

    both = side(source, "source").join(side(rendered, "rendered"), ["site_id", "url"], "full")
    return both.select(
        "*",
        F.when(F.col("in_source").isNull(), F.lit("rendered_only"))
        .when(F.col("in_rendered").isNull(), F.lit("source_only"))
        .otherwise(F.lit("matched"))
        .alias("presence"),
        *[(~F.col(f"source_{c}").eqNullSafe(F.col(f"rendered_{c}"))).alias(f"{c}_changed") for c in (*signals, "html_sha256")],
    )


def provenance_issues(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """Pages whose digest is not declared, or declared differently; repeated declarations too.

    ``declared`` has ``url, sha256``.
    """
    named = declared.select(urls.normalized(urls.crawl_form(F.col("url"))).alias("url"), F.lower("sha256").alias("sha256"))
    per_url = named.groupBy("url").agg(
        F.count("*").alias("n"), F.min("sha256").alias("declared"), F.bool_and(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("ok")
    )
    joined = facts.select("site_id", "url", "html_sha256").join(per_url, "url", "left")
    issue = (
        F.when(F.col("n").isNull(), F.lit("not_declared"))
        .when(F.col("n") > 1, F.lit("declared_twice"))
        .when(~F.col("ok"), F.lit("digest_malformed"))
        .when(F.col("declared") != F.col("html_sha256"), F.lit("digest_mismatch"))
    )
    return joined.select("site_id", "url", issue.alias("issue")).filter("issue IS NOT NULL")
