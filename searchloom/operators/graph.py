"""Link graph: inbound counts, click depth, redirect chains, route lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.functions import urls
from searchloom.session import cut_lineage, scratch_path

# Fixed value: hops beyond which a chain counts as too long.
MAX_REDIRECTS = 10


def page_graph(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between known pages of one site, without self-links.

    ``pages``: ``site_id, url``; ``edges``: ``site_id, source, target``.
    """
    own = pages.select("site_id", "url")
    plain = edges.select("site_id", "source", "target").filter("source <> target").distinct()
    return plain.join(own.withColumnRenamed("url", "target"), ["site_id", "target"], "left_semi").join(
        own.withColumnRenamed("url", "source"), ["site_id", "source"], "left_semi"
    )


def inbound_counts(pages: DataFrame, graph: DataFrame) -> DataFrame:
    counts = graph.groupBy("site_id", F.col("target").alias("url")).agg(F.count("*").alias("inbound"))
    return pages.select("site_id", "url").join(counts, ["site_id", "url"], "left").fillna(0, ["inbound"])


def click_depth(graph: DataFrame, roots: DataFrame, buckets: int | None = None) -> DataFrame:
    """Shortest click distance from each site's root, by frontier rounds until no page is new.

    All sites advance together. Edges lie in buckets by their source and visited pages in buckets by their URL, so a round moves neither: edges are
    followed where the newest pages lie, the pages found travel once to their buckets, and what was visited before is taken out there. Each
    round is appended to a table in the shared folder; a lost executor repeats one round.
    """
    spark = graph.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"depth_{uuid.uuid4().hex}"

    folder = scratch_path(spark, "depth")
    edges_table, pages_table = f"{name}_edges", f"{name}_pages"

    def keep(df: DataFrame, table: str, column: str, mode: str = "error") -> None:
        df.write.mode(mode).bucketBy(n, "site_id", column).option("path", f"{folder}/{table}").saveAsTable(table)

    keep(graph.select("site_id", "source", "target").repartition(n, "site_id", "source"), edges_table, "source")
    keep(roots.select("site_id", "url").repartition(n, "site_id", "url").distinct().withColumn("depth", F.lit(0)), pages_table, "url")
    depth = 0
    while True:
        visited = spark.table(pages_table)
        # the bucketed table is scanned in place for both: the newest pages, and all of them
        newest = visited.filter(F.col("depth") == depth).select("site_id", F.col("url").alias("source"))
        found = spark.table(edges_table).join(newest, ["site_id", "source"]).select("site_id", F.col("target").alias("url"))
        fresh = next_pages(found, visited, n).withColumn("depth", F.lit(depth + 1))
        keep(fresh, pages_table, "url", "append")
        spark.catalog.refreshTable(pages_table)
        depth += 1
        if spark.table(pages_table).filter(F.col("depth") == depth).isEmpty():
            break
    spark.sql(f"DROP TABLE {edges_table}")
    out = spark.read.schema("site_id string, url string, depth int").parquet(f"{folder}/{pages_table}")
    spark.sql(f"DROP TABLE {pages_table}")
    return out


def next_pages(found: DataFrame, visited: DataFrame, buckets: int) -> DataFrame:
    """Distinct pages of ``found`` that were not ``visited``, in the visited table's buckets."""
    return found.repartition(buckets, "site_id", "url").distinct().join(visited.select("site_id", "url"), ["site_id", "url"], "left_anti")


def follow(hops: DataFrame) -> DataFrame:
    """``url, at, hops, closed``: where each row of ``hops`` (``url, next``) leads to, by pointer doubling.

    A round sends every row on to where its target's row has come, so a chain of n hops takes about log2 n rounds. ``closed`` rows ended at
    a URL without a row of its own; when a round closes no further row the others lead into a circle.
    """
    walk = cut_lineage(hops.select("url", F.col("next").alias("at"), F.lit(1).cast("bigint").alias("hops"), F.lit(False).alias("closed")), "redirects")
    left = None
    while left != (left := walk.filter("NOT closed").count()) and left:
        on = walk.select(F.col("url").alias("_from"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("closed").alias("_closed"))
        moved = walk.join(on, walk["at"] == on["_from"], "left")
        step = ~F.col("closed") & F.col("_from").isNotNull()
        walk = cut_lineage(
            moved.select(
                "url",
                F.when(step, F.col("_at")).otherwise(F.col("at")).alias("at"),
                (F.col("hops") + F.when(step, F.col("_hops")).otherwise(0)).alias("hops"),
                (F.col("closed") | F.col("_from").isNull() | F.coalesce("_closed", F.lit(False))).alias("closed"),
            ),
            "redirects",
        )
    return walk


def _circles(hops: DataFrame) -> DataFrame:
    """``url, length`` of the URLs on circles of ``hops``, all of whose rows lead into circles.

    Doubling keeps the smallest URL met on the way. A URL that is the smallest of those it met itself has come round: it marks its circle. The
    circle's other URLs are those its mark meets, found by the same jumps.
    """
    jumps = [cut_lineage(hops.select("url", F.col("next").alias("at"), F.col("next").alias("low")), "circles")]
    while True:
        last = jumps[-1]
        marks = last.filter(F.col("low") == F.col("url")).select("url")
        # a row is done when the jump leads to a row whose smallest URL is a mark
        smallest = last.select(F.col("url").alias("at"), F.col("low").alias("mark"))
        ahead = last.select("url", "at").join(smallest, "at")
        if ahead.join(marks.select(F.col("url").alias("mark")), "mark", "left_anti").isEmpty():
            break
        on = last.select(F.col("url").alias("_from"), F.col("at").alias("_at"), F.col("low").alias("_low"))
        joined = last.join(on, F.col("at") == F.col("_from"))
        jumps.append(cut_lineage(joined.select("url", F.col("_at").alias("at"), F.least("low", "_low").alias("low")), "circles"))
    reached = cut_lineage(marks.select("url", F.col("url").alias("mark")), "circles")
    for jump in jumps:
        there = reached.join(jump.select("url", "at"), "url").select(F.col("at").alias("url"), "mark")
        reached = cut_lineage(reached.unionByName(there).distinct(), "circles")
    length = reached.groupBy("mark").agg(F.count("*").alias("length"))
    return reached.join(length, "mark").select("url", "length")


def resolve_redirects(redirects: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """Follow each URL's redirect to its end or until it returns to a URL met before, however long the chain.

    ``redirects``: ``url, location`` with one row per url. ``hops`` and ``final_url`` are those of the whole chain; ``state`` is
    ``loop``, ``too_long`` for an ending chain of more than ``max_hops``, or ``resolved``. A chain that runs into a circle ends where it enters
    it, after once around. Rounds are equi-joins and their number is logarithmic in the longest chain; rows carry no paths (see
    ``redirect_paths``).
    """
    hops = cut_lineage(redirects.select("url", F.col("location").alias("next")), "redirects")
    walk = follow(hops)
    long = F.when(F.col("hops") > max_hops, F.lit("too_long")).otherwise(F.lit("resolved"))
    out = walk.filter("closed").select("url", F.col("at").alias("final_url"), F.col("hops").cast("int").alias("hops"), long.alias("state"))
    rest = walk.filter("NOT closed").select("url")
    if rest.isEmpty():
        return out
    open_hops = cut_lineage(hops.join(rest, "url", "left_semi"), "redirects")
    circles = cut_lineage(_circles(open_hops), "circles")
    on_circle = circles.select("url", F.col("url").alias("final_url"), F.col("length").alias("hops"))
    # the rows before a circle end at its first URL they meet
    before = follow(open_hops.join(circles, "url", "left_anti"))
    entered = before.join(circles.select(F.col("url").alias("at"), "length"), "at").select("url", F.col("at").alias("final_url"), (F.col("hops") + F.col("length")).alias("hops"))
    looped = on_circle.unionByName(entered).select("url", "final_url", F.col("hops").cast("int").alias("hops"), F.lit("loop").alias("state"))
    return out.unionByName(looped)


def redirect_paths(redirects: DataFrame, resolved: DataFrame) -> DataFrame:
    """``url, step, at`` of the chains in ``resolved`` (``url, hops``), from step 0, the URL itself, to its last hop.

    Meant for the chains a report shows: a row per hop, found by doubling jumps, never one list per chain.
    """
    most = resolved.agg(F.max("hops")).first()[0]
    steps = resolved.select("url", "hops", F.lit(0).alias("step"), F.col("url").alias("at"))
    jump, length = cut_lineage(redirects.select("url", F.col("location").alias("next")), "paths"), 1
    while most is not None and length <= most:
        go = jump.select(F.col("url").alias("at"), "next")
        there = steps.join(go, "at").select("url", "hops", (F.col("step") + length).alias("step"), F.col("next").alias("at"))
        steps = cut_lineage(steps.unionByName(there.filter("step <= hops")), "paths")
        doubled = jump.join(jump.select(F.col("url").alias("next"), F.col("next").alias("_on")), "next")
        jump, length = cut_lineage(doubled.select("url", F.col("_on").alias("next")), "paths"), 2 * length
    return steps.select("url", "step", "at")


def match_routes(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """First file-route spelling of each wanted URL that exists; NULL when none does.

    ``wanted``: ``site_id, target``; ``known``: ``site_id, url``. Spellings are exploded and equi-joined.
    """
    distinct = wanted.select("site_id", "target").distinct()
    spelled = distinct.select("site_id", "target", F.posexplode(urls.route_variants(F.col("target"))).alias("k", "url"))
    hit = spelled.join(known.select("site_id", "url").distinct(), ["site_id", "url"])
    best = hit.groupBy("site_id", "target").agg(F.min_by("url", "k").alias("matched"))
    return distinct.join(best, ["site_id", "target"], "left")


def match_assets(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset of each wanted URL: exact, or without its query string."""
    distinct = wanted.select("site_id", "target").distinct()
    full = urls.normalized(F.col("target"))
    bare = F.regexp_replace(full, r"\?.*$", "")
    spelled = distinct.select("site_id", "target", F.posexplode(F.array_distinct(F.array(full, bare))).alias("k", "url"))
    hit = spelled.join(assets.select("site_id", "url").distinct(), ["site_id", "url"])
    best = hit.groupBy("site_id", "target").agg(F.min_by("url", "k").alias("matched"))
    return distinct.join(best, ["site_id", "target"], "left")
