"""Text signals: reported decline, review material, and which measurement source a text speaks of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signal patterns, case-insensitive.
RECOVERY = (
    r"(?:自然搜索|搜索|organic\s+)?(?:流量|点击|曝光|排名|收录|索引).{0,12}(?:下滑|下降|骤降|暴跌|锐减|减少|丢失|消失|掉出|异常)",
    r"(?:下滑|下降|骤降|暴跌|锐减|丢失|异常).{0,12}(?:自然搜索|搜索|流量|点击|曝光|排名|收录|索引)",
    r"(?:索引|收录)(?:覆盖)?(?:异常|故障|问题)",
    r"\b(?:organic\s+)?(?:traffic|clicks?|impressions?|rankings?|indexed pages?).{0,24}(?:drop|declin|fall|loss|decreas|plummet|anomal)",
    r"\b(?:deindex(?:ed|ing)?|indexing (?:issue|problem|anomaly)|index coverage issue)\b",
)
RECOVERY_NEGATIONS = (
    r"(?:没有|并无|未发现|未出现|不存在|无)(?:明显|明确|任何)?(?:的)?\s*(?:(?:自然搜索|搜索|站点|网站|页面|gsc)\s*)?(?:流量|点击|曝光|排名|收录|索引).{0,8}(?:下滑|下降|骤降|暴跌|锐减|减少|丢失|消失|掉出|异常)",
    r"\b(?:no|without)\s+(?:organic\s+)?(?:traffic|clicks?|impressions?|rankings?|indexing).{0,16}(?:drop|declin|loss|issue|problem|anomaly)\b",
)
RECOVERY_HYPOTHETICALS = (
    r"(?:防止|避免|预防|防范|降低).{0,24}(?:自然搜索|搜索|流量|点击|曝光|排名|收录|索引).{0,16}(?:下滑|下降|骤降|减少|丢失|异常)",
    r"(?:下滑|下降|骤降|减少|丢失|异常).{0,6}(?:风险|可能|预警|预防)",
    r"\b(?:prevent|avoid|mitigat\w*|reduce the risk of).{0,36}(?:traffic|clicks?|impressions?|rankings?|indexing).{0,20}(?:drop|declin|loss|issue|anomal)",
    r"(?:如果|假如|一旦|万一|是否|假设).{0,48}(?:自然搜索|搜索|流量|点击|曝光|排名|收录|索引).{0,20}(?:下滑|下降|骤降|减少|丢失|异常)",
    r"\b(?:if|whether|suppose|assuming).{0,64}(?:traffic|clicks?|impressions?|rankings?|indexing).{0,24}(?:drop|declin|loss|issue|anomal)",
)
# One of these stands in every text that a pattern above cuts or RECOVERY meets; the second row holds Chinese words.
RECOVERY_LITERALS = (
    ("traffic", "click", "impression", "ranking", "index"),
    ("搜索", "流量", "点击", "曝光", "排名", "收录", "索引", "下滑", "下降", "骤降", "暴跌", "锐减", "减少", "丢失", "异常"),
)
RECOVERY_OBSERVED = (
    r"(?:已|已经|当前|目前|最近|近期|过去|今年|去年|上月|本月|本周|开始|出现|发生|突然|骤然|以来|下降了|减少了|丢失了)",
    r"(?:骤降|暴跌|锐减|消失|掉出)",
    r"\b(?:has|have|had|currently|recently|since|started|began|observed|dropped|declined|fell|lost|last (?:week|month|quarter|year))\b",
)
DEPLOYED = (
    r"(?:已|已经|刚刚|已完成).{0,24}(?:上线|发布|部署|改版|修复|迁移|变更)",
    r"(?:上线|发布|部署|改版|修复|迁移|变更).{0,16}(?:已完成|已结束|完成于)",
    r"\b(?:deployed|released|launched|rolled out|went live)\b",
)
REVIEW_FILES = (
    r"(?:^|[._\-/\s])(?:gsc|ga4|crm)(?:[._\-/\s]|$)",
    r"(?:search[ _-]?console|google[ _-]?analytics|experiment|holdout|a[ _-]?b[ _-]?test|实验|对照组)",
)
REVIEW_DATA = (
    r"(?:gsc|search console).{0,32}(?:clicks?|impressions?|ctr|position|点击|曝光|排名|导出|数据)",
    r"(?:ga4|google analytics).{0,32}(?:sessions?|users?|conversions?|会话|用户|转化|导出|数据)",
    r"(?:crm).{0,32}(?:leads?|opportunities|revenue|线索|商机|收入|询盘|导出|数据)",
    r"(?:实验|experiment|holdout|a\/b test).{0,32}(?:结果|报告|数据|窗口|样本|result|report|data|window|sample)",
)
REVIEW_AVAILABLE = (
    r"(?:已有|已提供|已上传|已导出|已附上|数据可用|包含数据)",
    r"\b(?:available|provided|attached|uploaded|exported|included)\b",
)
SOURCES = {
    "gsc": (
        r"(?:^|[._\-/\s])gsc(?:[._\-/\s]|$)",
        r"search[ _-]?console",
        r"(?:query|page).{0,40}(?:clicks?|impressions?|ctr|position)",
    ),
    "ga4": (
        r"(?:^|[._\-/\s])ga4(?:[._\-/\s]|$)",
        r"google[ _-]?analytics",
        r"(?:landing[ _-]?page|sessions?|users?).{0,40}(?:conversions?|events?)",
    ),
    "crm": (
        r"(?:^|[._\-/\s])crm(?:[._\-/\s]|$)",
        r"(?:qualified[ _-]?leads?|opportunit(?:y|ies)|revenue|合格线索|商机|收入)",
    ),
    "deployment": (
        r"(?:^|[._\-/\s])(?:deploy|deployment|release|changelog)(?:[._\-/\s]|$)",
        r"(?:已|已经|刚刚|已完成).{0,24}(?:上线|发布|部署|改版|修复|迁移|变更)",
        r"\b(?:deployed|released|launched|rolled out|went live)\b",
    ),
}


def _java(pattern: str) -> str:
    """Word edges are ASCII ones, whatever the JVM's own idea of a word is."""
    out = pattern.replace(r"\b(", r"(?<![A-Za-z0-9_])(")
    return "(?i)" + out.replace(r")\b", r")(?![A-Za-z0-9_])")


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(_java(p)) for p in patterns])


def recovery_possible(text: Column) -> Column:
    """False for texts that hold none of the words every recovery pattern needs; nothing is cut from those either, so they have no signal."""
    lowered = F.lower(text)
    latin, chinese = (reduce(lambda a, b: a | b, [lowered.contains(w) for w in words]) for words in RECOVERY_LITERALS)
    return latin | (text.rlike("[\u4e00-\u9fff]") & chinese)


def recovery_signal(texts: DataFrame, text: str = "text") -> DataFrame:
    """``recovery``: an observed decline that is neither denied nor hypothetical.

    Patterns meet only texts with a word that all of them need. The cleaned text is a staged column, so the seven removals run once per row.
    """
    cleaned = F.col(text)
    for pattern in (*RECOVERY_NEGATIONS, *RECOVERY_HYPOTHETICALS):
        cleaned = F.regexp_replace(cleaned, _java(pattern), "")
    staged = texts.withColumn("_c", F.when(recovery_possible(F.col(text)), cleaned).otherwise(F.when(F.col(text).isNotNull(), F.lit(""))))
    return staged.withColumn(
        "recovery", matches_any(F.col("_c"), RECOVERY) & matches_any(F.col("_c"), RECOVERY_OBSERVED)
    ).drop("_c")


def _usable_file() -> Column:
    return (F.col("size") > 0) & (F.trim("content") != "")


def review_signal() -> Column:
    """Columns ``project_text, name, type, content, size`` of one project-file row."""
    project, content = F.col("project_text"), F.col("content")
    both = F.concat(project, F.lit("\n"), content)
    by_file = _usable_file() & matches_any(F.concat("name", F.lit("\n"), "type"), REVIEW_FILES)
    return (
        matches_any(both, DEPLOYED)
        | (matches_any(project, REVIEW_DATA) & matches_any(project, REVIEW_AVAILABLE))
        | matches_any(content, REVIEW_DATA)
        | by_file
    )


def source_tags(files: DataFrame) -> DataFrame:
    """One boolean per measurement source for each file."""
    text = F.concat("name", F.lit("\n"), "type", F.lit("\n"), "content")
    staged = files.withColumn("_t", text)
    return staged.withColumns({s: _usable_file() & matches_any(F.col("_t"), p) for s, p in SOURCES.items()}).drop("_t")


def evidence_availability(tagged: DataFrame) -> DataFrame:
    """Per project: which sources any of its files speaks of; deployment also counts the project text."""
    own = F.bool_or(matches_any(F.col("project_text"), SOURCES["deployment"]))
    return tagged.groupBy("project_id").agg(
        F.bool_or(_usable_file()).alias("files"),
        *[F.bool_or(s).alias(s) for s in ("gsc", "ga4", "crm")],
        (F.bool_or("deployment") | own).alias("deployment"),
    )
