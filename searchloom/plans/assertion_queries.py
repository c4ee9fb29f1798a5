"""Contract assertions over conversations, documents and derived work reports."""

from pyspark.sql import functions as F

from searchloom.operators import assertions as a
from searchloom.plans import sqltext as q
from searchloom.plans.compare_queries import issue_list
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, table, with_views

PATH = "'$.' || regexp_replace(target, '[.]([0-9]+)', '[\\1]', 'g')"


@query(
    "i1_resolve_path",
    with_views("json_responses")
    + f"SELECT conv_id, turn, target, CAST(json_extract(response::JSON, {PATH}) AS VARCHAR) AS value FROM json_responses",
)
def i1(spark, sf):
    rows = load_view(spark, sf, "json_responses")
    return rows.select("conv_id", "turn", "target", a.resolve_path(F.col("response"), F.col("target")).alias("value"))


PATTERNS = (("que", "[aeiou]{2}"), ("[0-9]{3}",), ("le.*la", "\\n"), ("zzz", "ÉT"))
CHOICE = "(conv_id + turn) % 4"


def _all(op: str, neg: str) -> str:
    return "CASE " + CHOICE + " " + " ".join(
        f"WHEN {i} THEN " + "(" + f" {op} ".join(f"{neg} regexp_matches(text, '(?is){p}')" for p in ps) + ")" for i, ps in enumerate(PATTERNS)
    ) + " END"


@query(
    "i2_regex_assertions",
    f"SELECT conv_id, turn, {_all('AND', '')} AS all_match, {_all('AND', 'NOT')} AS none_match FROM conversations",
)
def i2(spark, sf):
    sets = F.array(*[F.array(*[F.lit(p) for p in ps]) for ps in PATTERNS])
    chosen = F.element_at(sets, ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    rows = table(spark, sf, "conversations").withColumn("patterns", chosen)
    text, patterns = F.col("text"), F.col("patterns")
    return rows.select(
        "conv_id", "turn", a.regex_all(text, patterns).alias("all_match"), a.regex_none(text, patterns).alias("none_match")
    )


@query(
    "i3_jsonpath_equals",
    with_views("json_responses")
    + f"SELECT conv_id, turn, coalesce(CAST(json_extract(response::JSON, {PATH}) AS VARCHAR) = replace(expected, ' ', ''), FALSE) AS passed FROM json_responses",
)
def i3(spark, sf):
    rows = load_view(spark, sf, "json_responses")
    same = a.resolve_path(F.col("response"), F.col("target")) == a.canonical_json(F.col("expected"))
    return rows.select("conv_id", "turn", F.coalesce(same, F.lit(False)).alias("passed"))


@query(
    "i4_fact_set_equals",
    with_views("json_responses")
    + """SELECT conv_id, turn, array_to_string(list_sort(list_filter(want, lambda w: NOT list_contains(have, w))), ',') AS missing,
      array_to_string(list_sort(list_distinct(list_filter(have, lambda h: NOT list_contains(want, h)))), ',') AS extra
    FROM (SELECT *, ['f0', 'f1', 'g'] AS want, ['f' || (conv_id % 3), 'f' || (turn % 4), 'g'] AS have FROM json_responses) t""",
)
def i4(spark, sf):
    rows = load_view(spark, sf, "json_responses")
    have = F.from_json(F.get_json_object("response", "$.facts"), "array<string>")
    want = F.array(F.lit("f0"), F.lit("f1"), F.lit("g"))
    missing, extra = a.set_difference(have, want)
    return rows.select("conv_id", "turn", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


NORM = r"regexp_replace(lower(trim({0})), '\s+', ' ', 'g')"
FAILURES = "checked AS (SELECT claim_id, case_key, source_id, is_numeric, CASE WHEN known IS NULL THEN ['source_absent'] ELSE list_concat(" + issue_list(
    "CASE WHEN source_type = 'public_web' AND NOT regexp_matches(locator, '^https?://[^/?#]+') THEN 'locator_invalid' END",
    "CASE WHEN source_type = 'public_web' AND NOT coalesce(http_status BETWEEN 200 AND 299, FALSE) THEN 'no_successful_status' END",
    "CASE WHEN source_type = 'provided_data' AND NOT regexp_matches(locator, '^[A-Za-z][A-Za-z0-9+.-]*:[^?#]') THEN 'locator_invalid' END",
    "CASE WHEN source_type = 'memory' THEN 'source_type_unsupported' END",
    "CASE WHEN snapshot_status <> 'captured' THEN 'snapshot_not_captured' END",
    "CASE WHEN length(trim(snapshot_excerpt)) < 20 THEN 'snapshot_excerpt_short' WHEN supported_claim IS NULL AND supporting_excerpt IS NULL THEN 'support_missing' END",
) + ", CASE WHEN length(trim(snapshot_excerpt)) >= 20 AND NOT (supported_claim IS NULL AND supporting_excerpt IS NULL) THEN " + issue_list(
    f"CASE WHEN trim(coalesce(supported_claim, '')) = '' THEN 'support_claim_missing' WHEN NOT contains({NORM.format('claim_text')}, {NORM.format('supported_claim')}) THEN 'support_claim_not_in_text' END",
    f"CASE WHEN length(trim(coalesce(supporting_excerpt, ''))) < 10 THEN 'support_excerpt_short' WHEN NOT contains({NORM.format('snapshot_excerpt')}, {NORM.format('supporting_excerpt')}) THEN 'support_excerpt_not_in_snapshot' END",
) + " ELSE [] END) END AS failures FROM claims LEFT JOIN (SELECT *, 1 AS known FROM claim_sources) s USING (source_id))"
CLAIMS = with_views("claims", "claim_sources", extra=FAILURES)


@query("i5_source_support", CLAIMS + "SELECT claim_id, source_id, array_to_string(failures, ',') AS failures FROM checked")
def i5(spark, sf):
    out = a.claim_failures(load_view(spark, sf, "claims"), load_view(spark, sf, "claim_sources"))
    return out.select("claim_id", "source_id", F.array_join("failures", ",").alias("failures"))


@query(
    "i6_citation_coverage",
    CLAIMS
    + f"""SELECT *, {q.r10("covered / required")} AS ratio, covered / required >= 0.2 AS coverage_passed, numeric_unsupported = 0 AND numeric_claims >= 1 AS numeric_passed
    FROM (SELECT case_key, count(*) AS required, count(*) FILTER (len(failures) = 0) AS covered, count(*) FILTER (is_numeric) AS numeric_claims,
      count(*) FILTER (is_numeric AND len(failures) > 0) AS numeric_unsupported FROM checked GROUP BY ALL) t""",
)
def i6(spark, sf):
    checked = a.claim_failures(load_view(spark, sf, "claims"), load_view(spark, sf, "claim_sources"))
    return a.citation_coverage(checked, min_ratio=0.2)


@query(
    "i7_work_report_checks",
    with_views("work_reports")
    + """SELECT o_orderkey, b1 <> a1 AS changed, p2 = 'docs/b.md' AS unchanged, exit_1 = 0 AND exit_2 = 0 AS succeeded, p2 NOT LIKE '/%' AND p2 NOT LIKE '../%' AS confined FROM work_reports""",
)
def i7(spark, sf):
    rows = load_view(spark, sf, "work_reports")
    file = lambda i: F.struct(F.col(f"p{i}").alias("path"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after"))
    run = lambda name, c: F.struct(F.lit(name).alias("command"), F.col(c).alias("exit_code"))
    files, commands = F.array(file(1), file(2)), F.array(run("lint", "exit_1"), run("test", "exit_2"))
    return rows.select(
        "o_orderkey",
        a.files_in_state(files, F.array(F.lit("a.md")), changed=True).alias("changed"),
        a.files_in_state(files, F.array(F.lit("docs/b.md")), changed=False).alias("unchanged"),
        a.commands_succeed(commands, F.array(F.lit("lint"), F.lit("test"))).alias("succeeded"),
        a.paths_confined(F.array("p1", "p2")).alias("confined"),
    )


@query(
    "i8_changelog_and_graph",
    with_views("work_reports")
    + """SELECT 'log-' || o_orderkey AS item, CASE WHEN before_log = '' THEN TRUE ELSE suffix(after_log, before_log) AND length(after_log) > length(before_log) END AS passed FROM work_reports
    UNION ALL SELECT 'graph-' || l_suppkey, count(*) FILTER (l_returnflag = 'R' AND NOT both_sides) = 0 AND count(*) FILTER (l_returnflag <> 'R' AND NOT both_sides) = 0 FROM (
      SELECT l_suppkey, l_returnflag, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey, l_linenumber, l_partkey % 2) = 2 AS both_sides FROM lineitem) t GROUP BY l_suppkey""",
)
def i8(spark, sf):
    rows = load_view(spark, sf, "work_reports")
    none = F.array().cast("array<string>")
    before = F.when(F.col("before_log") == "", none).otherwise(F.split("before_log", ","))
    logs = rows.select(
        F.concat(F.lit("log-"), F.col("o_orderkey").cast("string")).alias("item"),
        a.changelog_grows(before, F.split("after_log", ",")).alias("passed"),
    )
    edges = table(spark, sf, "lineitem").select(
        F.concat(F.lit("graph-"), F.col("l_suppkey").cast("string")).alias("case_key"),
        F.col("l_linenumber").alias("source"),
        (F.col("l_partkey") % 2).alias("target"),
        (F.col("l_returnflag") == "R").alias("is_actual"),
    )
    graphs = a.link_graphs_equal(edges.filter("is_actual"), edges.filter("NOT is_actual"))
    return logs.unionByName(graphs.select(F.col("case_key").alias("item"), "passed"))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _route_sql() -> str:
    build = f"{_has(a.SKILL_WORDS)} AND {_has(a.BUILD_WORDS)}"
    parts = [
        f"WHEN {build} AND {_has(a.SEO_WORDS)} THEN 'FACTORY'",
        f"WHEN {build} THEN 'GENERIC_SKILL'",
        f"WHEN {_has(a.AD_WORDS)} AND NOT {_has(a.SEARCH_TERM_WORDS)} THEN 'NONE'",
        f"WHEN {_has(a.CONCEPT_WORDS)} AND NOT {_has(a.PROJECT_WORDS)} THEN 'NONE'",
    ]
    for name, words in a.ROUTE_WORDS:
        extra = {"KEYWORD": f" OR ({_has(a.PAID_TERMS)} AND {_has(a.SEARCH_TERM_WORDS)})", "AUDIT": " OR contains(t, 'http://') OR contains(t, 'https://')"}
        parts.append(f"WHEN {_has(words)}{extra.get(name, '')} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'NONE' END"


ROUTED = f"routed AS (SELECT text_id, {_route_sql()} AS route FROM (SELECT text_id, {NORM.format('text')} AS t FROM prompts) p)"


@query("i9_route_heuristic", with_views("prompts", extra=ROUTED) + "SELECT text_id, route, route = 'AUDIT' AS equals_audit, route <> 'NONE' AS not_none FROM routed")
def i9(spark, sf):
    routed = load_view(spark, sf, "prompts").select("text_id", a.route(F.col("text")).alias("route"))
    return routed.select(
        "*", (F.col("route") == "AUDIT").alias("equals_audit"), (F.col("route") != "NONE").alias("not_none")
    )


SANITY = r"""sanity AS (SELECT text_id, sum(n)::BIGINT AS tokens, count(t) AS distinct_tokens, max(n) AS top_count FROM (
    SELECT text_id, t, count(t) AS n FROM (SELECT text_id, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS t FROM (
      SELECT text_id, regexp_extract_all(lower(trim(text)), '[a-z0-9][a-z0-9+.#-]*|[一-鿿]{2,}') AS ts FROM prompts) a) b GROUP BY ALL) c GROUP BY text_id)"""


@query(
    "i10_text_sanity",
    with_views("prompts", extra=SANITY)
    + "SELECT *, tokens >= 8 AND (top_count / tokens >= 0.5 OR distinct_tokens / tokens <= 0.2) AS stuffed FROM sanity",
)
def i10(spark, sf):
    return a.text_sanity(load_view(spark, sf, "prompts"))


RESULTS = """results AS (SELECT o_orderpriority AS suite, 'case-' || o_custkey AS case_key, 'a' || (o_orderkey % 5) AS assertion_id,
    CASE o_orderkey % 4 WHEN 0 THEN 'route_equals' WHEN 1 THEN 'regex_all' WHEN 2 THEN 'jsonpath_equals' ELSE 'fact_set_equals' END AS type,
    o_totalprice > 60000 AS passed, o_orderkey % 3 = 0 AS hard_gate, CAST(1 + o_orderkey % 3 AS DOUBLE) AS weight FROM orders),
  cases AS (SELECT o_orderpriority AS suite, 'case-' || o_custkey AS case_key FROM orders GROUP BY o_orderpriority, o_custkey),
  answered AS (SELECT DISTINCT 'case-' || c_custkey AS case_key FROM customer WHERE c_acctbal > 0)"""


@query(
    "i11_suite_summary",
    f"WITH {RESULTS}"
    + f"""SELECT *, hard_failures = 0 AND missing_responses = 0 AND coalesce(soft_pass_rate >= 0.9, TRUE) AS strict_passed FROM (
      SELECT suite, count(*) AS assertions, count(*) FILTER (passed) AS passed, {q.r10("sum(weight) FILTER (passed) / sum(weight)")} AS weighted_pass_rate,
        {q.r10("sum(weight) FILTER (passed AND type <> 'route_equals') / sum(weight) FILTER (type <> 'route_equals')")} AS non_route_pass_rate,
        count(*) FILTER (hard_gate AND NOT passed) AS hard_failures, {q.r10("sum(weight) FILTER (passed AND NOT hard_gate) / sum(weight) FILTER (NOT hard_gate)")} AS soft_pass_rate FROM results GROUP BY suite) s
    LEFT JOIN (SELECT suite, count(*) AS duplicate_assertion_ids FROM (SELECT suite, case_key, assertion_id FROM results GROUP BY ALL HAVING count(*) > 1) d GROUP BY suite) d USING (suite)
    LEFT JOIN (SELECT suite, count(*) AS missing_responses FROM cases WHERE case_key NOT IN (SELECT case_key FROM answered) GROUP BY suite) m USING (suite)""",
)
def i11(spark, sf):
    for name in ("orders", "customer"):
        table(spark, sf, name).createOrReplaceTempView(name)
    read = lambda name: spark.sql(f"WITH {RESULTS} SELECT * FROM {name}")
    return a.suite_summary(read("results"), read("cases"), read("answered"))
