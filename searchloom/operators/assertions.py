"""Contract assertions over tables of responses: paths, patterns, facts, citations, suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.operators.compare import code, issue_list

# Prompt keywords of each route, in the order routes are tried.
BUILD_WORDS = ("创建", "新建", "做成", "封装", "改进", "优化", "重构", "create", "build", "improve")
SKILL_WORDS = ("skill", "技能")
SEO_WORDS = ("seo", "搜索优化")
AD_WORDS = ("广告组", "campaign", "出价", "预算", "投放计划", "广告文案", "否定关键词", "转化出价")
SEARCH_TERM_WORDS = ("用于 seo", "帮助 seo", "自然搜索", "自然排名", "搜索词报告", "seo 情报")
CONCEPT_WORDS = ("什么是 seo", "seo 是什么", "解释一下 seo", "seo 和 sem 的区别", "what is seo")
PROJECT_WORDS = ("我的", "我们", "这个站", "网站", "页面", "项目", "代码库", "url", "http")
PAID_TERMS = ("搜索词报告", "search terms", "paid search terms")
ROUTE_WORDS = (
    ("WRITE_BRIEF", ("大纲", "字数规划", "列一下字数", "content brief")),
    ("RECOVER", ("流量暴跌", "流量下降", "流量掉", "索引暴跌", "排名集体下降", "恢复流量", "recover")),
    ("MEMORY", ("继续上次", "之前做到哪", "上次做到哪", "记下来", "记录下来", "项目记忆", "建一下项目记忆")),
    ("PLAN", ("90 天", "90天", "路线图", "执行计划", "seo 计划", "启动 seo", "每周做什么", "每月看什么", "接下来 30-90", "接下来该干嘛")),
    ("REVIEW", ("见效", "复盘", "有没有效果", "排名涨", "流量有变化", "改动效果", "月度 seo")),
    ("LINK", ("内链", "外链", "反向链接", "孤儿页", "链接方面", "link building", "backlink", "outreach")),
    ("WRITE", ("写一篇", "写篇", "重写", "成稿", "稿子", "seo 文章", "博客出来", "文章交付")),
    ("KEYWORD", ("关键词", "哪些词", "高意图", "搜索量", "这个词", "几个词", "大词", "keyword")),
    ("FIX", ("帮我改", "帮我修", "补上", "修复", "直接改", "加 schema", "加结构化数据", "改好", "能改", "implement")),
    ("AUDIT", ("审查", "体检", "看看", "检查", "查一下", "为什么", "排不上", "有没有风险", "诊断", "audit")),
)
TOKEN_PATTERN = r"[a-z0-9][a-z0-9+.#-]*|[一-鿿]{2,}"
SOFT_RATE_NEEDED = 0.90


def normalize_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def json_path(dotted: Column) -> Column:
    """``a.0.b`` -> ``$.a[0].b``."""
    return F.concat(F.lit("$."), F.regexp_replace(dotted, r"\.([0-9]+)(?=\.|$)", "[$1]"))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spaces; NULL for malformed text."""
    return F.to_json(F.try_parse_json(text))


def resolve_path(response: Column, dotted: Column) -> Column:
    """Value at a dotted path as canonical JSON; NULL when the path does not exist."""
    return F.to_json(F.try_variant_get(F.try_parse_json(response), json_path(dotted), "variant"))


def regex_all(text: Column, patterns: Column) -> Column:
    return F.forall(patterns, lambda p: F.rlike(text, F.concat(F.lit("(?isu)"), p)))


def regex_none(text: Column, patterns: Column) -> Column:
    return ~F.exists(patterns, lambda p: F.rlike(text, F.concat(F.lit("(?isu)"), p)))


def set_difference(actual: Column, expected: Column) -> tuple[Column, Column]:
    """Missing and extra members, both sorted."""
    return F.array_sort(F.array_except(expected, actual)), F.array_sort(F.array_except(actual, expected))


def claim_failures(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Why a claim is not supported by its source.

    ``claims``: ``claim_id, claim_text, source_id, supported_claim, supporting_excerpt``; ``sources``:
    ``source_id, source_type, locator, http_status, snapshot_status, snapshot_excerpt``. The join key is
    the source id; a source cited by very many claims is one row on its side.
    """
    joined = claims.join(sources.withColumn("_known", F.lit(True)), "source_id", "left")
    kind, excerpt = F.col("source_type"), F.col("snapshot_excerpt")
    short = F.length(F.trim(F.coalesce(excerpt, F.lit("")))) < 20
    support, claim = F.col("supporting_excerpt"), F.col("supported_claim")
    has_support = claim.isNotNull() | support.isNotNull()
    url_ok = F.coalesce(F.col("locator").rlike("^https?://[^/?#]+"), F.lit(False))
    uri_ok = F.coalesce(F.col("locator").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]+|[^?#/]|/[^?#/])"), F.lit(False))
    checks = issue_list(
        code((kind == "public_web") & ~url_ok, "locator_invalid"),
        code((kind == "public_web") & ~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), "no_successful_status"),
        code((kind == "provided_data") & ~uri_ok, "locator_invalid"),
        code(~F.coalesce(kind.isin("public_web", "provided_data"), F.lit(False)), "source_type_unsupported"),
        code(~F.col("snapshot_status").eqNullSafe(F.lit("captured")), "snapshot_not_captured"),
        F.when(short, F.lit("snapshot_excerpt_short")).when(~has_support, F.lit("support_missing")),
    )
    detail = F.when(
        ~short & has_support,
        issue_list(
            F.when(F.trim(F.coalesce(claim, F.lit(""))) == "", F.lit("support_claim_missing")).when(
                ~F.contains(normalize_text(F.col("claim_text")), normalize_text(claim)), F.lit("support_claim_not_in_text")
            ),
            F.when(F.length(F.trim(F.coalesce(support, F.lit("")))) < 10, F.lit("support_excerpt_short")).when(
                ~F.contains(normalize_text(excerpt), normalize_text(support)), F.lit("support_excerpt_not_in_snapshot")
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))
    failures = F.when(F.col("_known").isNull(), F.array(F.lit("source_absent"))).otherwise(F.concat(checks, detail))
    keep = [c for c in claims.columns if c not in ("claim_text", "supported_claim", "supporting_excerpt")]
    return joined.select(*keep, failures.alias("failures"))


def citation_coverage(checked: DataFrame, min_ratio: float, min_numeric: int = 1) -> DataFrame:
    """Per case: share of supported claims, and whether every numeric claim has support.

    ``checked`` is ``claim_failures`` output with ``case_key`` and ``is_numeric``.
    """
    good = F.size("failures") == 0
    per = checked.groupBy("case_key").agg(
        F.count("*").alias("required"),
        F.count_if(good).alias("covered"),
        F.count_if("is_numeric").alias("numeric_claims"),
        F.count_if(F.col("is_numeric") & ~good).alias("numeric_unsupported"),
    )
    ratio = F.col("covered") / F.col("required")
    return per.withColumns(
        {
            "ratio": F.bround(ratio, 10),
            "coverage_passed": ratio >= min_ratio,
            "numeric_passed": (F.col("numeric_unsupported") == 0) & (F.col("numeric_claims") >= min_numeric),
        }
    )


def files_in_state(files: Column, wanted: Column, changed: bool) -> Column:
    """Every wanted path has the wanted change state; unknown paths fail."""

    def ok(path: Column) -> Column:
        mine = F.filter(files, lambda f: f["path"] == path)
        differs = ~F.try_element_at(mine, F.lit(-1))["before"].eqNullSafe(F.try_element_at(mine, F.lit(-1))["after"])
        return (F.size(mine) > 0) & (differs if changed else ~differs)

    return F.forall(wanted, ok)


def commands_succeed(commands: Column, wanted: Column) -> Column:
    def ok(command: Column) -> Column:
        mine = F.filter(commands, lambda c: c["command"] == command)
        return F.coalesce(F.try_element_at(mine, F.lit(-1))["exit_code"] == 0, F.lit(False))

    return F.forall(wanted, ok)


def paths_confined(paths: Column) -> Column:
    """No absolute path and no parent step."""
    return F.forall(paths, lambda p: ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), ".."))


def changelog_grows(before: Column, after: Column, min_new: int = 1) -> Column:
    """The old entries remain as the tail, and enough new ones stand before them."""
    added = F.size(after) - F.size(before)
    tail = F.slice(after, F.greatest(added + 1, F.lit(1)), F.greatest(F.size(before), F.lit(1)))
    kept = (F.size(before) == 0) | ((added >= 0) & (tail == before))
    return kept & (added >= min_new)


def link_graphs_equal(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: distinct edges of both sides agree. Inputs: ``case_key, source, target``."""
    keys = ["case_key", "source", "target"]
    left = actual.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    both = left.join(right, keys, "full")
    return both.groupBy("case_key").agg(
        F.count_if(F.col("_a").isNull()).alias("missing_edges"),
        F.count_if(F.col("_e").isNull()).alias("extra_edges"),
        (F.count_if(F.col("_a").isNull() | F.col("_e").isNull()) == 0).alias("passed"),
    )


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def route(prompt: Column) -> Column:
    """First matching route of a prompt."""
    text = normalize_text(prompt)
    build = _any_of(text, SKILL_WORDS) & _any_of(text, BUILD_WORDS)
    paid = _any_of(text, PAID_TERMS) & _any_of(text, SEARCH_TERM_WORDS)
    chosen = (
        F.when(build & _any_of(text, SEO_WORDS), F.lit("FACTORY"))
        .when(build, F.lit("GENERIC_SKILL"))
        .when(_any_of(text, AD_WORDS) & ~_any_of(text, SEARCH_TERM_WORDS), F.lit("NONE"))
        .when(_any_of(text, CONCEPT_WORDS) & ~_any_of(text, PROJECT_WORDS), F.lit("NONE"))
    )
    for name, words in ROUTE_WORDS:
        hit = _any_of(text, words)
        if name == "KEYWORD":
            hit = hit | paid
        if name == "AUDIT":
            hit = hit | prompt.rlike(r"(?i)https?://")
        chosen = chosen.when(hit, F.lit(name))
    return chosen.otherwise(F.lit("NONE"))


def text_sanity(texts: DataFrame) -> DataFrame:
    """Token statistics of each text and whether it looks like repeated keywords.

    A row's tokens are sorted and its runs counted inside the row, so nothing is shuffled.
    """
    found = F.regexp_extract_all(F.lower(F.trim("text")), F.lit(TOKEN_PATTERN), F.lit(0))
    rows = texts.select("text_id", F.array_sort(F.coalesce(found, F.array().cast("array<string>"))).alias("_t"))

    def run(state: Column, token: Column) -> Column:
        n = F.when(state["last"] == token, state["n"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(token.alias("last"), n.alias("n"), F.greatest(state["top"], n).alias("top"), (state["kinds"] + (n == 1).cast("bigint")).alias("kinds"))

    none = F.lit(0).cast("bigint")
    start = F.struct(F.lit(None).cast("string").alias("last"), none.alias("n"), none.alias("top"), none.alias("kinds"))
    counted = rows.select("text_id", F.size("_t").cast("bigint").alias("tokens"), F.aggregate("_t", start, run).alias("_s"))
    stats = counted.select("text_id", "tokens", F.col("_s.kinds").alias("distinct_tokens"), F.col("_s.top").alias("top_count"))
    stuffed = (F.col("tokens") >= 8) & (
        (F.col("top_count") / F.col("tokens") >= 0.5) | (F.col("distinct_tokens") / F.col("tokens") <= 0.2)
    )
    return stats.withColumn("stuffed", stuffed)


def suite_summary(results: DataFrame, cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Per suite: weighted pass rates, hard failures, missing responses and the strict gate."""
    w, ok = F.col("weight"), F.col("passed")
    hard, route_type = F.col("hard_gate"), F.col("type").isin("route_equals", "route_not_equals")

    def rate(scope: Column) -> Column:
        total = F.sum(F.when(scope, w))
        return F.bround(F.when(total != 0, F.sum(F.when(scope & ok, w).otherwise(F.when(scope, 0.0))) / total), 10)

    scored = results.groupBy("suite").agg(
        F.count("*").alias("assertions"),
        F.count_if(ok).alias("passed"),
        rate(F.lit(True)).alias("weighted_pass_rate"),
        rate(~route_type).alias("non_route_pass_rate"),
        F.count_if(hard & ~ok).alias("hard_failures"),
        rate(~hard).alias("soft_pass_rate"),
    )
    repeated = (
        results.groupBy("suite", "case_key", "assertion_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy("suite")
        .agg(F.count("*").alias("duplicate_assertion_ids"))
    )
    missing = (
        cases.join(responses.select("case_key").distinct(), "case_key", "left_anti")
        .groupBy("suite")
        .agg(F.count("*").alias("missing_responses"))
    )
    out = scored.join(repeated, "suite", "left").join(missing, "suite", "left").fillna(
        0, ["duplicate_assertion_ids", "missing_responses"]
    )
    strict = (
        (F.col("hard_failures") == 0)
        & (F.col("missing_responses") == 0)
        & F.coalesce(F.col("soft_pass_rate") >= SOFT_RATE_NEEDED, F.lit(True))
    )
    return out.withColumn("strict_passed", strict)
