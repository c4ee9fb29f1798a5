"""Reading, typing and normalising inputs."""

from pyspark.sql import functions as F

import searchloom.plans.views  # noqa: F401
from searchloom.functions import dates, numbers, urls
from searchloom.operators import gates, landing_pages
from searchloom.plans import sqltext as q
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, table, with_views
from searchloom.session import cut_lineage, scratch_path
from searchloom.sources import exports, files

RAW = with_views("raw_search")
BASE = "https://shop.example.com/catalog/"


def _raw(spark, sf):
    return load_view(spark, sf, "raw_search")


@query(
    "a1_read_search_csv",
    with_views("search_daily")
    + """SELECT property_id, count(*) AS rows, sum(clicks) AS clicks, sum(impressions) AS impressions,
    count(position) AS position_rows, count(DISTINCT day)::BIGINT AS days,
    0::BIGINT AS long_rows FROM search_daily GROUP BY property_id""",
)
def a1(spark, sf):
    """Round trip: the search rows written as CSV and read by the export reader."""
    # both kinds of files are written from the same rows
    rows = cut_lineage(load_view(spark, sf, "search_daily"), "search-daily")
    path = scratch_path(spark, "export")
    columns = [
        F.col("day").cast("string").alias("Date"),
        F.concat_ws("|", "property_id", "page").alias("Top pages"),
        # line breaks and quotes inside a field, so that records and lines differ
        F.when(F.dayofmonth("day") % 3 == 0, F.concat_ws("\n", "query", F.lit('the "second", line'))).otherwise(F.col("query")).alias("查询"),
        F.col("country").alias("Country"),
        F.col("device").alias("Device"),
        F.col("clicks").cast("string").alias("Clicks"),
        F.col("impressions").cast("string").alias("展示次数"),
        F.col("position").cast("string").alias("Average position"),
    ]
    # two kinds of files in one folder: other order, other delimiter
    odd = F.dayofmonth("day") % 2 == 1
    rows.filter(odd).select(*columns).write.option("header", True).option("escape", '"').option("sep", ";").csv(path)
    rows.filter(~odd).select(*columns[::-1]).write.mode("append").option("header", True).option("escape", '"').csv(path)
    back = exports.read_search_csv(spark, path)
    typed = gates.typed_search_rows(back)
    return typed.groupBy(F.substring_index("page", "|", 1).alias("property_id")).agg(
        F.count("*").alias("rows"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.count("position").alias("position_rows"),
        F.countDistinct("day").alias("days"),
        F.count("row_issue").alias("long_rows"),
    )


@query(
    "a3_parse_number",
    RAW
    + f"""SELECT impressions_text, CASE WHEN v >= 0 THEN v END AS value, issue, count(*) AS rows
    FROM (SELECT impressions_text, {q.number("impressions_text")} AS v,
      {q.number_issue("impressions_text", "'blank'")} AS issue FROM raw_search) t GROUP BY ALL""",
)
def a3(spark, sf):
    return (
        numbers.with_numbers(_raw(spark, sf), {"n": F.col("impressions_text")})
        .select(
            "impressions_text",
            numbers.non_negative("n").alias("value"),
            numbers.number_issue("n", blank_allowed=False).alias("issue"),
        )
        .groupBy("impressions_text", "value", "issue")
        .agg(F.count("*").alias("rows"))
    )


@query(
    "a4_parse_date",
    RAW
    + f"""SELECT date_text, {q.date("date_text")}::STRING AS day, count(*) AS rows FROM raw_search GROUP BY ALL""",
)
def a4(spark, sf):
    day = dates.parse_date(F.col("date_text"))
    return _raw(spark, sf).groupBy("date_text", day.cast("string").alias("day")).agg(F.count("*").alias("rows"))


@query(
    "a5_clicks_above_impressions",
    RAW
    + f"""SELECT part_id, count(*) AS rows, sum(CASE WHEN {q.number("clicks_text")} > v THEN 1 ELSE 0 END)::BIGINT AS rejected
    FROM (SELECT *, {q.number("impressions_text")} AS v FROM raw_search) t WHERE v >= 0 GROUP BY part_id""",
)
def a5(spark, sf):
    texts = {"c": F.col("clicks_text"), "i": F.col("impressions_text")}
    rows = numbers.with_numbers(_raw(spark, sf), texts).filter("i_number >= 0")
    return rows.groupBy("part_id").agg(
        F.count("*").alias("rows"),
        F.count(gates.clicks_above_impressions(F.col("c_number"), F.col("i_number"))).alias("rejected"),
    )


@query(
    "a6_duplicate_grain",
    "SELECT l_partkey, l_suppkey, l_linestatus, l_linenumber, count(*) AS rows FROM lineitem "
    "GROUP BY ALL HAVING count(*) > 1",
)
def a6(spark, sf):
    return gates.duplicate_grain(
        table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_linestatus", "l_linenumber"]
    )


@query(
    "a7_read_ai_csv",
    with_views("search_daily")
    + """SELECT country, sum(impressions) AS impressions, count(*) AS rows, min(day)::STRING AS first_day
    FROM (SELECT day, country, device, sum(impressions) AS impressions FROM search_daily GROUP BY ALL) t GROUP BY country""",
)
def a7(spark, sf):
    rows = load_view(spark, sf, "search_daily").groupBy("day", "country", "device").agg(F.sum("impressions").alias("n"))
    path = scratch_path(spark, "ai-export")
    columns = [
        F.col("day").cast("string").alias("日期"),
        F.col("country").alias("Top countries"),
        F.col("device").alias("Top devices"),
        F.col("n").cast("string").alias("Impression"),
    ]
    odd = F.dayofmonth("day") % 2 == 1
    rows.filter(odd).select(*columns).write.option("header", True).csv(path)
    rows.filter(~odd).select(*columns[::-1]).write.mode("append").option("header", True).csv(path)
    back = exports.read_ai_csv(spark, path)
    back = numbers.with_numbers(back, {"n": F.col("impressions")})
    value = numbers.non_negative("n")
    return back.groupBy("country").agg(
        F.sum(value).alias("impressions"),
        F.count("*").alias("rows"),
        F.min(dates.parse_date(F.col("date"), dates.AI_DATE_FORMATS)).cast("string").alias("first_day"),
    )


@query(
    "a8_placeholder_zero",
    RAW
    + f"""SELECT country_text, count(*) AS rows,
      sum(CASE WHEN trim(impressions_text) IN ('~', '-') THEN 1 ELSE 0 END)::BIGINT AS placeholder_rows,
      sum(CASE WHEN trim(impressions_text) IN ('~', '-') THEN 0.0 WHEN v >= 0 THEN v END)::DOUBLE AS impressions
    FROM (SELECT *, {q.number("impressions_text")} AS v FROM raw_search) t GROUP BY country_text""",
)
def a8(spark, sf):
    text = F.col("impressions_text")
    value = numbers.non_negative("n")
    return (
        numbers.with_numbers(_raw(spark, sf), {"n": text})
        .groupBy("country_text")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(numbers.is_placeholder(text)).alias("placeholder_rows"),
            F.sum(F.when(numbers.is_placeholder(text), F.lit(0.0)).otherwise(value)).alias("impressions"),
        )
    )


STAMPS = """stamped AS (SELECT user_id, event_id, ts,
  CASE event_id % 6 WHEN 0 THEN CAST(CAST(ts AS DATE) AS STRING)
    WHEN 1 THEN replace(CAST(CAST(ts AS DATE) AS STRING), '-', '/')
    WHEN 2 THEN substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8) || 'Z'
    WHEN 3 THEN substr(CAST(ts AS STRING), 1, 19) || '+08:00'
    WHEN 4 THEN substr(CAST(ts AS STRING), 1, 19) ELSE ' ' END AS day_text FROM events)"""


@query(
    "a11_parse_day_or_timestamp",
    f"""WITH {STAMPS}, d AS (SELECT user_id, event_id % 6 AS k, date_trunc('second', ts) AS ts,
      CAST(ts AS DATE) AS d FROM stamped),
    e AS (SELECT user_id, CASE WHEN k IN (0, 1) THEN d
        WHEN k = 2 THEN ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai')::DATE
        WHEN k = 3 THEN ts::DATE
        WHEN k = 4 THEN ((ts AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'Asia/Shanghai')::DATE END AS day,
      CASE WHEN k IN (0, 1) THEN 'date' WHEN k = 5 THEN 'unknown' ELSE 'timestamp' END AS grain FROM d)
    SELECT user_id, day::STRING AS day, grain, count(*) AS rows FROM e GROUP BY ALL""",
)
def a11(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events")
    rows = spark.sql(f"WITH {STAMPS} SELECT user_id, day_text FROM stamped")
    text = F.col("day_text")
    day = dates.parse_day(text, F.lit("America/Los_Angeles"), F.lit("Asia/Shanghai"))
    return rows.groupBy("user_id", day.cast("string").alias("day"), dates.temporal_grain(text).alias("grain")).agg(
        F.count("*").alias("rows")
    )


@query(
    "a12_nullable_metric",
    RAW
    + f"""SELECT position_text, {q.number("position_text")} AS value,
      {q.number_issue("position_text", "NULL")} AS issue, count(*) AS rows FROM raw_search GROUP BY ALL""",
)
def a12(spark, sf):
    issue = numbers.number_issue("n", blank_allowed=True)
    return (
        numbers.with_numbers(_raw(spark, sf), {"n": F.col("position_text")})
        .groupBy("position_text", numbers.non_negative("n").alias("value"), issue.alias("issue"))
        .agg(F.count("*").alias("rows"))
    )


@query(
    "a13_dimension_mapping",
    RAW
    + """SELECT CASE WHEN c = '' THEN NULL WHEN n.n_name IS NOT NULL THEN 'country-' || n.n_nationkey ELSE c END AS country,
      CASE lower(trim(device_text)) WHEN 'desktop' THEN 'computer' ELSE lower(trim(device_text)) END AS device,
      count(*) AS rows
    FROM (SELECT *, lower(trim(country_text)) AS c FROM raw_search) r
    LEFT JOIN nation n ON r.c = lower(n.n_name) GROUP BY ALL""",
)
def a13(spark, sf):
    """Value maps: a joined table for countries, a literal map for devices."""
    country_map = table(spark, sf, "nation").select(
        F.lower("n_name").alias("c"), F.concat(F.lit("country-"), F.col("n_nationkey").cast("string")).alias("mapped")
    )
    key = F.lower(F.trim("country_text"))
    device = F.lower(F.trim("device_text"))
    device_map = F.create_map(F.lit("desktop"), F.lit("computer"))
    rows = _raw(spark, sf).select(key.alias("c"), F.coalesce(device_map[device], device).alias("device"))
    counted = rows.groupBy("c", "device").agg(F.count("*").alias("n"))
    country = F.coalesce("mapped", F.when(F.col("c") != "", F.col("c")))
    return counted.join(country_map, "c", "left").groupBy(country.alias("country"), "device").agg(F.sum("n").alias("rows"))


@query(
    "a14_landing_page_normaliser",
    RAW
    + f"""SELECT url_text, CASE WHEN v IS NULL THEN NULL ELSE coalesce(m.target, v) END AS landing_page,
      CASE WHEN trim(url_text) = '' THEN 'blank_landing_page' WHEN v IS NULL THEN 'invalid_landing_page' END AS reason,
      m.target IS NOT NULL AS explicitly_mapped, count(*) AS rows
    FROM (SELECT url_text, CASE WHEN trim(url_text) <> '' AND regexp_matches(j, '^https?://[^/?#]+', 'i') THEN
        {q.site("'https'", "j")} || CASE WHEN {q.tidy_path("j")} = '/' THEN '/' ELSE regexp_replace({q.tidy_path("j")}, '/+$', '') END END AS v
      FROM (SELECT url_text, {q.join_url(BASE, "trim(url_text)")} AS j FROM raw_search) a) b
    LEFT JOIN (SELECT 'https://shop.example.com/part/' || p_partkey AS source,
        'https://shop.example.com/family/' || p_size AS target FROM part WHERE p_size <= 10) m ON b.v = m.source
    GROUP BY ALL""",
)
def a14(spark, sf):
    """Distinct spellings are counted first, so each is normalised and looked up once."""
    counted = _raw(spark, sf).groupBy("url_text").agg(F.count("*").alias("rows"))
    pairs = (
        table(spark, sf, "part")
        .filter("p_size <= 10")
        .select(
            F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("source"),
            F.concat(F.lit("https://shop.example.com/family/"), F.col("p_size").cast("string")).alias("target"),
        )
    )
    found = landing_pages.with_landing_pages(counted, "url_text", landing_pages.UrlRules(BASE), pairs)
    return found.select("url_text", "landing_page", F.col("url_reason").alias("reason"), "explicitly_mapped", "rows")


@query(
    "a15_crawl_url_canonical",
    f"""SELECT page_id, {q.crawl("url")} AS crawl_url, {q.normalized("url")} AS normalized_url,
      {q.origin("url")} AS origin FROM pages""",
)
def a15(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.crawl_form(url).alias("crawl_url"),
        urls.normalized(url).alias("normalized_url"),
        urls.origin(url).alias("origin"),
    )


@query(
    "a16_resolve_link",
    RAW
    + f"""SELECT url_text, CASE WHEN t = '' OR starts_with(t, '#') OR lower({q.url_part("t", 1)}) IN
      ('mailto', 'tel', 'javascript', 'data', 'blob') THEN NULL ELSE {q.crawl("j")} END AS target, count(*) AS rows
    FROM (SELECT url_text, trim(url_text) AS t, {q.join_url(BASE, "trim(url_text)")} AS j FROM raw_search) a GROUP BY ALL""",
)
def a16(spark, sf):
    target = urls.resolve_link(F.lit(BASE), F.col("url_text"))
    return (
        _raw(spark, sf)
        .select("url_text", target.alias("target"))
        .groupBy("url_text", "target")
        .agg(F.count("*").alias("rows"))
    )


@query(
    "a20_site_tree_urls",
    """SELECT path, CASE WHEN page_id % 3 = 2 THEN 'asset' ELSE 'page' END AS kind,
      'https://site.example.com/' || CASE page_id % 3 WHEN 0 THEN 'd' || page_id || '/'
        WHEN 1 THEN 'd' || page_id || '/about.html' ELSE 'd' || page_id || '/logo.png' END AS url FROM (
      SELECT page_id, 'd' || page_id || CASE page_id % 3 WHEN 0 THEN '/index.html' WHEN 1 THEN '/about.html'
        ELSE '/logo.png' END AS path FROM pages) t""",
)
def a20(spark, sf):
    """Pages written as a tree of HTML files and assets, and the tree scanned."""
    tree = files.scan_tree(spark, _site_tree(spark, sf))
    return files.tree_urls(tree, F.lit("https://site.example.com")).select("path", "kind", "url")


def _site_tree(spark, sf):
    name = F.expr("concat('d', page_id, CASE page_id % 3 WHEN 0 THEN '/index.html' WHEN 1 THEN '/about.html' ELSE '/logo.png' END)")
    root = scratch_path(spark, "site-tree")
    files.write_tree(table(spark, sf, "pages").select(name.alias("path"), F.col("html").cast("binary").alias("content")), root)
    return root


@query("a21_source_digest", "SELECT page_id, octet_length(encode(html))::BIGINT AS length, sha256(html) AS sha256 FROM pages")
def a21(spark, sf):
    """Digest of every file of the tree, read back from the files."""
    page = F.regexp_extract("path", "^d([0-9]+)/", 1).cast("bigint")
    return files.scan_tree(spark, _site_tree(spark, sf)).select(page.alias("page_id"), "length", "sha256")


@query(
    "a22_report_sink",
    with_views("search_daily")
    + """SELECT property_id, country, sum(clicks) AS clicks, sum(impressions) AS impressions FROM search_daily GROUP BY ALL""",
)
def a22(spark, sf):
    report = (
        load_view(spark, sf, "search_daily")
        .groupBy("property_id", "country")
        .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    )
    path = scratch_path(spark, "report")
    # a run for some properties, then one for all: the first ones are found unchanged, the others are added
    some = report.filter("property_id < 'property-3'")
    files.write_report(some, path, ["property_id"])
    files.write_report(report, path, ["property_id"])
    files.write_report(some, path, ["property_id"])
    return spark.read.schema(report.schema).json(path)
