"""robots.txt as tables: groups and rules, the rules an agent obeys, and blocked URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions import urls

CRAWLER = "googlebot"


def robots_lines(robots: DataFrame) -> DataFrame:
    """Cleaned ``field: value`` lines of each document, in order."""
    lines = robots.select("site_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    return lines.select("site_id", "line_no", text.alias("t")).filter(F.instr("t", ":") > 0).select(
        "site_id",
        "line_no",
        F.lower(F.trim(F.substring_index("t", ":", 1))).alias("field"),
        F.trim(F.regexp_replace("t", "^[^:]*:", "")).alias("value"),
    )


def parse_robots(robots: DataFrame) -> DataFrame:
    """``site_id, line_no, group_id, agents, directive, pattern`` plus sitemap and noindex lines.

    A user-agent line opens a group unless it directly continues a list of agents. The window runs over
    the lines of one document, which is one input cell.
    """
    lines = robots_lines(robots)
    order = Window.partitionBy("site_id").orderBy("line_no")
    member = F.col("field").isin("user-agent", "allow", "disallow")
    grouped = lines.filter(member).withColumn("_before", F.lag("field").over(order))
    opens = (F.col("field") == "user-agent") & F.coalesce(F.col("_before") != "user-agent", F.lit(True))
    numbered = grouped.withColumn("group_id", F.sum(opens.cast("int")).over(order))
    whole = Window.partitionBy("site_id", "group_id")
    agent = F.when(F.col("field") == "user-agent", F.lower("value"))
    listed = F.array_sort(F.collect_set(agent).over(whole))
    rules = numbered.select(
        "site_id",
        "line_no",
        "group_id",
        F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("*"))).alias("agents"),
        F.col("field").alias("directive"),
        F.col("value").alias("pattern"),
    ).filter("directive <> 'user-agent'")
    none = F.array().cast("array<string>")
    others = lines.filter(F.col("field").isin("sitemap", "noindex") & ((F.col("field") == "noindex") | (F.col("value") != "")))
    return rules.unionByName(
        others.select(
            "site_id", "line_no", F.lit(0).cast("bigint").alias("group_id"), none.alias("agents"),
            F.col("field").alias("directive"), F.col("value").alias("pattern"),
        )
    )


def rules_for_agent(parsed: DataFrame, agent: str = CRAWLER, longest_token: bool = False) -> DataFrame:
    """Rules of the groups naming the agent, else of the ``*`` groups.

    ``longest_token`` keeps only the groups with the longest agent token that starts the product name.
    """
    rules = parsed.filter(F.col("directive").isin("allow", "disallow"))
    name = F.lit(agent.lower())
    if longest_token:
        tokens = F.transform(
            "agents",
            lambda a: F.when(a == "*", F.lit(0)).otherwise(
                F.when(
                    (F.regexp_replace(a, "[^a-z0-9_-]", "") != "") & name.startswith(F.regexp_replace(a, "[^a-z0-9_-]", "")),
                    F.length(F.regexp_replace(a, "[^a-z0-9_-]", "")),
                ).otherwise(F.lit(-1))
            ),
        )
        fit = F.array_max(tokens)
    else:
        named = F.exists("agents", lambda a: (a != "*") & F.contains(name, a))
        fit = F.when(named, F.lit(1)).when(F.array_contains("agents", "*"), F.lit(0)).otherwise(F.lit(-1))
    scored = rules.withColumn("_fit", fit).filter("_fit >= 0")
    best = scored.groupBy("site_id").agg(F.max("_fit").alias("_best"))
    return scored.join(best, "site_id").filter("_fit = _best").select("site_id", "line_no", "directive", "pattern")


def _regex(pattern: Column) -> Column:
    """``*`` matches anything, a final ``$`` anchors; all else is literal."""
    body = F.regexp_replace(pattern, r"\$$", "")
    literal = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(
        F.lit("(?s)^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit(""))
    )


def rule_table(rules: DataFrame) -> DataFrame:
    """One row per site with its usable rules; a rule list is bounded by one robots document.

    ``start`` is what stands before the first wildcard; a rule without ``*`` and ``$`` is nothing else and needs no pattern.
    """
    body = F.regexp_replace("pattern", r"\$$", "")
    plain = ~F.contains(F.col("pattern"), F.lit("*")) & ~F.col("pattern").endswith("$")
    specificity = F.length(F.regexp_replace(F.regexp_replace("pattern", r"\$$", ""), r"\*", ""))
    shaped = rules.filter("pattern <> ''").select(
        "site_id",
        F.struct(
            specificity.alias("len"), (F.col("directive") == "allow").alias("allow"),
            F.substring_index(body, "*", 1).alias("start"), F.when(~plain, _regex(F.col("pattern"))).alias("rx"),
        ).alias("rule"),
    )
    return shaped.groupBy("site_id").agg(F.collect_list("rule").alias("rules"))


def blocked(targets: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``blocked``: the longest matching rule decides and allow wins ties.

    Rules join once per site and are tried inside the row, so no URL x rule pairs are produced.
    """
    joined = targets.join(rule_table(rules), "site_id", "left")
    u = F.col(url)
    query = urls.query_string(u)
    path = F.when(urls.path(u) == "", F.lit("/")).otherwise(urls.path(u))
    staged = joined.withColumn(
        "_pq", F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))
    )
    none = F.array().cast("array<struct<len:int,allow:boolean,start:string,rx:string>>")
    # a pattern is compiled only for the rules with wildcards whose literal beginning fits
    fits = lambda r: F.startswith(F.col("_pq"), r["start"]) & (r["rx"].isNull() | F.rlike(F.col("_pq"), r["rx"]))
    hits = F.filter(F.coalesce("rules", none), fits)
    winner = F.array_max(F.transform(hits, lambda r: F.struct(r["len"], r["allow"])))
    return staged.withColumn("blocked", F.coalesce(~winner["allow"], F.lit(False))).drop("_pq", "rules")
