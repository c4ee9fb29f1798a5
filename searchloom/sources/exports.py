"""Readers for exported CSV tables: header mapping at schema time, typed rows with issue codes."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.sources import csv_records

# Header names of search-performance exports.
SEARCH_HEADERS = {
    "date": "date",
    "日期": "date",
    "query": "query",
    "top queries": "query",
    "热门查询": "query",
    "查询": "query",
    "page": "page",
    "top pages": "page",
    "热门网页": "page",
    "网页": "page",
    "country": "country",
    "countries": "country",
    "top countries": "country",
    "国家": "country",
    "地区": "country",
    "国家/地区": "country",
    "device": "device",
    "devices": "device",
    "设备": "device",
    "clicks": "clicks",
    "点击次数": "clicks",
    "点击": "clicks",
    "impressions": "impressions",
    "展示次数": "impressions",
    "展现次数": "impressions",
    "展示": "impressions",
    "ctr": "ctr",
    "average ctr": "ctr",
    "平均点击率": "ctr",
    "点击率": "ctr",
    "position": "position",
    "average position": "position",
    "排名": "position",
    "平均排名": "position",
}
# Header names of AI-surface exports, and the names that must not occur there.
AI_HEADERS = {
    "date": "date",
    "日期": "date",
    "page": "page",
    "pages": "page",
    "top pages": "page",
    "页面": "page",
    "网页": "page",
    "热门网页": "page",
    "country": "country",
    "countries": "country",
    "top countries": "country",
    "国家": "country",
    "地区": "country",
    "国家/地区": "country",
    "热门国家/地区": "country",
    "device": "device",
    "devices": "device",
    "top devices": "device",
    "设备": "device",
    "impressions": "impressions",
    "impression": "impressions",
    "展示次数": "impressions",
    "展现次数": "impressions",
    "展示": "impressions",
    "展现": "impressions",
}
AI_FORBIDDEN_HEADERS = (
    "query", "queries", "top queries", "查询", "热门查询",
    "click", "clicks", "点击", "点击次数",
    "ctr", "average ctr", "点击率", "平均点击率",
    "position", "average position", "排名", "平均排名",
    "citation", "citations", "引用",
    "conversion", "conversions", "转化", "转化次数",
    "revenue", "收入",
)
# Columns a review export may carry without mapping them, and refused columns.
REVIEW_GRAIN = {
    "search": ("date", "landing_page", "country", "device"),
    "analytics": ("date", "landing_page", "country", "device"),
    "crm": ("date", "landing_page", "country"),
}
REVIEW_REQUIRED_METRICS = {"search": ("clicks", "impressions"), "analytics": ("sessions", "conversions"), "crm": ()}
REVIEW_IGNORED = {
    "search": (
        "ctr", "average ctr", "点击率", "平均点击率",
        "position", "average position", "排名", "平均排名",
    ),
    "analytics": (),
    "crm": (),
}
QUERY_COLUMNS = (
    "query", "queries", "search_query", "search_queries", "search_term", "search_terms",
    "keyword", "keywords", "查询", "查询词", "搜索词", "关键词", "热门查询",
)
PERSONAL_COLUMNS = (
    "id", "email", "email_address", "e_mail", "phone", "phone_number", "mobile", "mobile_phone",
    "telephone", "lead_id", "contact_id", "customer_id", "user_id", "client_id", "visitor_id",
    "session_id", "account_id", "record_id", "order_id", "opportunity_id", "full_name", "first_name",
    "last_name", "name", "address", "ip", "ip_address", "cookie_id", "gclid", "msclkid", "fbclid",
    "邮箱", "电子邮箱", "手机号", "手机号码", "电话", "电话号码", "线索id", "联系人id", "用户id",
    "客户id", "姓名", "地址", "身份证", "身份证号",
)
CRM_RAW_COLUMNS = (
    "stage", "lead_stage", "status", "created_at", "updated_at", "owner", "sales_owner",
    "阶段", "线索阶段", "负责人",
)
DELIMITERS = (",", "\t", ";")


def header_key(name: str) -> str:
    return " ".join(name.replace("\ufeff", "").replace("_", " ").lower().split())


def canonical_headers(
    headers: Sequence[str],
    aliases: Mapping[str, str] = SEARCH_HEADERS,
    required: Sequence[str] = ("clicks", "impressions"),
    forbidden: Sequence[str] = (),
) -> dict[str, str]:
    """Original header -> canonical name. Blank, duplicate, unknown, forbidden or missing ones raise."""
    mapped: dict[str, str] = {}
    for original in headers:
        key = header_key(original)
        if not key:
            raise ValueError("blank column name")
        if key in forbidden:
            raise ValueError(f"column not allowed in this export: {original!r}")
        name = aliases.get(key)
        if name is None:
            raise ValueError(f"unknown column may change the grain: {original!r}")
        if name in mapped.values():
            raise ValueError(f"two columns map to {name!r}")
        mapped[original] = name
    for name in required:
        if name not in mapped.values():
            raise ValueError(f"missing column {name!r}")
    return mapped


def review_key(name: str) -> str:
    """Header key of configured columns: letters, digits and Chinese characters, all else one underscore."""
    return re.sub(r"[^0-9a-z\u4e00-\u9fff]+", "_", name.strip().lstrip("\ufeff").casefold()).strip("_")


def review_headers(
    kind: str, headers: Sequence[str], dimensions: Mapping[str, str], metrics: Mapping[str, str]
) -> dict[str, str]:
    """Configured mapping of one review source: canonical name -> header in the file."""
    if set(dimensions) != set(REVIEW_GRAIN[kind]):
        raise ValueError(f"{kind} needs exactly the dimensions {REVIEW_GRAIN[kind]}")
    for metric in metrics:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", metric):
            raise ValueError(f"metric names are snake_case: {metric!r}")
    absent = [m for m in REVIEW_REQUIRED_METRICS[kind] if m not in metrics]
    if absent or not metrics:
        raise ValueError(f"{kind} lacks required metrics {absent}")
    refuse_sensitive_headers(headers, crm=kind == "crm")
    by_key: dict[str, str] = {}
    for header in headers:
        if not review_key(header):
            raise ValueError("blank column name")
        if review_key(header) in by_key:
            raise ValueError(f"duplicate column {header!r}")
        by_key[review_key(header)] = header
    wanted = {**dimensions, **metrics}
    missing = [name for name, header in wanted.items() if review_key(header) not in by_key]
    if missing:
        raise ValueError(f"missing configured columns {missing}")
    resolved = {name: by_key[review_key(header)] for name, header in wanted.items()}
    if len(set(resolved.values())) != len(resolved):
        raise ValueError("one column is mapped twice")
    extra = [
        h for h in headers if h not in resolved.values() and review_key(h) not in map(review_key, REVIEW_IGNORED[kind])
    ]
    if extra:
        raise ValueError(f"undeclared columns may change the grain: {extra}")
    return resolved


def sensitive_header_kind(header: str) -> str | None:
    """Why a column name is refused: ``query``, ``personal`` or None."""
    snake = review_key(header)
    if snake in QUERY_COLUMNS:
        return "query"
    return "personal" if snake in PERSONAL_COLUMNS else None


def refuse_sensitive_headers(headers: Sequence[str], crm: bool = False) -> None:
    for header in headers:
        kind = sensitive_header_kind(header)
        if kind:
            raise ValueError(f"{kind} column refused: {header!r}")
        if crm and review_key(header) in CRM_RAW_COLUMNS:
            raise ValueError(f"row-level CRM column refused: {header!r}")


def header_lines(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """First line that is not blank -> files that begin with it; one row per file comes back."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
    filled = lines.filter(F.trim(F.replace(F.col("value"), F.lit("\ufeff"), F.lit(""))) != "")
    first = filled.groupBy("file_path").agg(F.min_by("value", F.struct("file_block_start", "_at")).alias("header"))
    files: dict[str, list[str]] = {}
    for row in first.orderBy("file_path").toLocalIterator():
        files.setdefault(row["header"].lstrip("\ufeff"), []).append(unquote(row["file_path"]))
    return files


def split_header(line: str) -> tuple[str, list[str]]:
    """Delimiter and column names of a header line; names may be quoted and hold delimiters."""
    outside = re.sub(r'"(?:[^"]|"")*"', "", line)
    delimiter = max(DELIMITERS, key=outside.count)
    return delimiter, [name.strip() for name in next(csv.reader([line], delimiter=delimiter))]


def read_export_csv(
    spark: SparkSession,
    path: str,
    aliases: Mapping[str, str] = SEARCH_HEADERS,
    required: Sequence[str] = ("clicks", "impressions"),
    forbidden: Sequence[str] = (),
) -> DataFrame:
    """All-string rows under canonical names, plus ``row_issue`` for rows longer or shorter than their header.

    Files are grouped by their own header, so columns may stand in any order in each. Quoted fields may hold doubled quotes,
    delimiters and line breaks, and a file is read by as many tasks as it has splits. Blank rows are dropped; a column that
    only some headers have is NULL in the other files.
    """
    return read_mapped_csv(spark, path, lambda names: canonical_headers(names, aliases, required, forbidden)).drop("file", "at")


def read_mapped_csv(spark: SparkSession, path: str, resolve: Callable[[Sequence[str]], Mapping[str, str]]) -> DataFrame:
    """All-string rows of the columns that ``resolve`` names, with ``file``, ``at`` (order in the file) and ``row_issue``.

    ``resolve`` gets the column names of a header and gives header -> name; it raises for headers it refuses. It is asked once per
    different header line, before any row is read.
    """
    groups = header_lines(spark, path)
    if not groups:
        raise ValueError("empty CSV")
    split = [(files, *split_header(line)) for line, files in groups.items()]
    mapped = [(files, delimiter, names, resolve(names)) for files, delimiter, names in split]
    out = None
    for files, delimiter, names, mapping in mapped:
        part = _read_group(spark, files, delimiter, names, mapping)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    last = ("file", "at", "row_issue")
    return out.select(*[c for c in out.columns if c not in last], *last)


def _read_group(spark: SparkSession, files: list[str], delimiter: str, names: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    # One spare field: a row filling it exactly is not malformed for the parser, yet too long for us.
    fields = [*(f"c{k}" for k in range(len(names))), "spare", "malformed"]
    options = {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed", "multiLine": "true"}
    records = csv_records.read_records(spark, files, delimiter).where(F.trim("record") != "")
    # rows of arrays of one keep the filter below from repeating the parser for every field it reads
    once = lambda column: F.explode(F.array(column))
    rows = records.select("path", "at", once(F.from_csv("record", ", ".join(f"{f} string" for f in fields), options)).alias("r"))
    cells = [F.col("r").getField(f"c{k}") for k in range(len(names))]
    # every proper row lacks the spare field, so the parser keeps its text; its delimiters outside quotes tell its length
    malformed = F.col("r").getField("malformed")
    length = F.size(F.split(F.regexp_replace(malformed, r'"(?:[^"]|"")*"', ""), re.escape(delimiter), -1))
    rows, found = rows.select("*", once(length).alias("_found")), F.col("_found")
    too_long = F.col("r").getField("spare").isNotNull() | malformed.isNull() | (found > len(names))
    blank = F.forall(F.array(*cells), lambda v: F.coalesce(F.trim(v), F.lit("")) == "")
    issue = F.when(too_long, F.lit("row_longer_than_header")).when(found < len(names), F.lit("row_shorter_than_header"))
    kept = [cell.alias(mapping[name]) for cell, name in zip(cells, names) if name in mapping]
    return rows.filter(~blank | too_long).select(*kept, F.col("path").alias("file"), "at", issue.alias("row_issue"))


def read_search_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_export_csv(spark, path)


def read_ai_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_export_csv(spark, path, AI_HEADERS, ("impressions",), AI_FORBIDDEN_HEADERS)
