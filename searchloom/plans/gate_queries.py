"""Personal-data and credential gates over whole texts."""

from pyspark.sql import functions as F

from searchloom.functions import privacy
from searchloom.operators import gates
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, view, with_views

# The checking database has no lookaround: neighbours are matched as characters instead.
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
EMAIL = (
    r"(?i)[A-Z0-9.!#$%&''*+/=?^_`{|}~-]+@(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,63}(?:[^A-Z0-9.-]|$)"
)
PHONES = (
    r"(?:^|[^0-9])(?:\+?86[ -]?)?1[3-9][0-9]{9}(?:[^0-9]|$)",
    EDGE_L + r"\+[0-9](?:[ .()\-]*[0-9]){7,14}(?:[^0-9]|$)",
    r"(?:^|[^0-9])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?:[^0-9]|$)",
)
PHONE_WORD = (
    rf"(?is)(?:{EDGE_L}(?:(?:phone|mobile|cell)[ _-]*(?:number|no)|telephone|tel|whatsapp|wechat){EDGE_R}|"
    r"电话|手机号|手机号码|联系电话).*(?:[0-9][ .()\-]*){7,15}"
)


def _any(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


def _resident(v: str) -> str:
    total = " + ".join(
        f"substr({v}, {i + 1}, 1)::INT * {w}" for i, w in enumerate(privacy.RESIDENT_ID_WEIGHTS)
    )
    return (
        f"(try_strptime(substr({v}, 7, 8), '%Y%m%d') IS NOT NULL AND upper(substr({v}, 18, 1)) = "
        f"substr('10X98765432', (({total}) % 11) + 1, 1))"
    )


def _query_kind(x: str) -> str:
    ids = rf"regexp_extract_all({x}, '(?:^|[^0-9])([0-9]{{17}}[0-9Xx])(?:[^\p{{L}}\p{{N}}_]|$)', 1)"
    tail = f"regexp_extract({x}, '(?is)(?:{privacy.ID_WORD})(.*)$', 1)"
    values = f"regexp_extract_all({tail}, '[A-Za-z0-9][A-Za-z0-9._:-]{{5,127}}')"
    return (
        f"CASE WHEN regexp_matches({x}, '{EMAIL}') THEN 'email' WHEN {_any(x, PHONES)} OR regexp_matches({x}, '{PHONE_WORD}') THEN 'phone' "
        f"WHEN len(list_filter({ids}, lambda v: {_resident('v')})) > 0 THEN 'resident_id' "
        f"WHEN len(list_filter({values}, lambda v: regexp_matches(v, '[0-9]'))) > 0 THEN 'stable_id' END"
    )


view(
    "all_texts",
    """
SELECT 'doc-' || doc_id AS text_id, text FROM documents
UNION ALL SELECT 'turn-' || conv_id || '-' || turn, text FROM conversations
UNION ALL SELECT 'item-' || item_id, text FROM benchmark
UNION ALL SELECT 'order-' || o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN 'customer id ' || o_custkey || '-' || o_orderkey WHEN 1 THEN 'call phone number 555' || o_orderkey || '0011'
    WHEN 2 THEN 'size 30mm 2024 sku ' || o_orderkey WHEN 3 THEN 'mail Buyer.' || o_custkey || '@shop-' || o_custkey || '.example.com now'
    WHEN 4 THEN '+44 20 7946 ' || lpad(CAST(o_custkey AS STRING), 4, '0') WHEN 5 THEN '电话 ' || o_custkey || ' 13812345678'
    WHEN 6 THEN 'passport renewal ' || o_orderpriority ELSE 'user_id is unknown' END FROM orders
""",
)


@query(
    "b1_query_pii_kind",
    with_views("all_texts") + f"SELECT text_id, {_query_kind('text')} AS kind FROM all_texts",
)
def b1(spark, sf):
    return load_view(spark, sf, "all_texts").select("text_id", privacy.query_pii_kind(F.col("text")).alias("kind"))


view(
    "resident_ids",
    """
SELECT o_orderkey, '110101' || replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '')
  || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || substr('0123456789Xx', CAST(o_orderkey % 12 AS INT) + 1, 1) AS candidate
FROM orders
UNION ALL SELECT o_orderkey, '11010119991332' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '1' FROM orders
UNION ALL SELECT o_orderkey, 'A' || o_orderkey FROM orders
""",
)


@query(
    "b2_resident_id_checksum",
    with_views("resident_ids")
    + f"SELECT o_orderkey, candidate, CASE WHEN regexp_matches(candidate, '^[0-9]{{17}}[0-9Xx]$') THEN {_resident('candidate')} ELSE FALSE END AS valid FROM resident_ids",
)
def b2(spark, sf):
    return load_view(spark, sf, "resident_ids").withColumn("valid", privacy.valid_resident_id(F.col("candidate")))


view(
    "tagged_urls",
    """
SELECT page_id, CASE page_id % 9
  WHEN 0 THEN url WHEN 1 THEN base || '?email=a' WHEN 2 THEN base || '?q=jane.doe%40example.org&x=1'
  WHEN 3 THEN base || '?user_id=' || (100000 + page_id) WHEN 4 THEN base || '#session-token=abc'
  WHEN 5 THEN base || '/call/%2B4420794600' || (10 + page_id % 90) WHEN 6 THEN base || '?tel=tel+555' || (1000000 + page_id)
  WHEN 7 THEN base || '/customer-id-' || (100000 + page_id) ELSE base || '?size=30mm&sku=' || (1000 + page_id) END AS url
FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '') AS base FROM pages) t
""",
)
_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
_FRAG = r"regexp_extract(url, '#(.*)$', 1)"
_REST = f"url_decode(replace(array_to_string(list_filter([{_QUERY}, {_FRAG}], lambda p: p <> ''), ' '), '+', ' '))"
_NAMES = (
    f"list_transform(list_concat(string_split({_QUERY}, '&'), string_split({_FRAG}, '&')), lambda p: string_split(p, '=')[1])"
)
_PARAM = f"len(list_filter({_NAMES}, lambda p: regexp_matches(trim(p), '{privacy.SENSITIVE_PARAMETER}'))) > 0"


@query(
    "b3_page_pii_kind",
    with_views("tagged_urls")
    + f"""SELECT page_id, coalesce(CASE WHEN path_kind <> 'stable_id' THEN path_kind END, {_query_kind("rest")},
        CASE WHEN {_PARAM} THEN 'sensitive_parameter' END) AS kind,
      CASE WHEN regexp_matches(whole, '{EMAIL}') THEN 'email' WHEN {_any("whole", PHONES)} THEN 'phone'
        WHEN len(list_filter(regexp_extract_all(regexp_extract(rest, '(?is)(?:{privacy.AI_ID_WORD})(.*)$', 1),
          '[A-Za-z0-9][A-Za-z0-9._:-]{{5,127}}'), lambda v: regexp_matches(v, '[0-9]'))) > 0 THEN 'stable_id'
        WHEN {_PARAM} THEN 'sensitive_parameter' END AS ai_kind
    FROM (SELECT *, {_query_kind("path")} AS path_kind, trim(path || ' ' || rest) AS whole
      FROM (SELECT page_id, url, url_decode({_PATH}) AS path, {_REST} AS rest FROM tagged_urls) a) b""",
)
def b3(spark, sf):
    url = F.col("url")
    return load_view(spark, sf, "tagged_urls").select(
        "page_id", privacy.page_pii_kind(url).alias("kind"), privacy.ai_page_pii_kind(url).alias("ai_kind")
    )


RECORD_EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?:[^\p{L}\p{N}_.-]|$)"
RECORD_PHONES = (
    r"(?:^|[^0-9])(?:\+?86[ -]?)?1[3-9][0-9](?:[ -]?[0-9]){8}(?:[^0-9]|$)",
    EDGE_L + r"\+[1-9][0-9](?:[ .()-]?[0-9]){7,13}(?:[^0-9]|$)",
)
CREDENTIALS = (
    ("api_token", EDGE_L + r"sk-[A-Za-z0-9_-]{15,}[A-Za-z0-9_]" + EDGE_R),
    ("source_host_token", EDGE_L + r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})" + EDGE_R),
    ("cloud_access_key", EDGE_L + r"(?:AKIA|ASIA)[A-Z0-9]{16}" + EDGE_R),
    ("search_api_key", EDGE_L + r"AIza[0-9A-Za-z_-]{29,}[0-9A-Za-z_]" + EDGE_R),
    ("payment_key", EDGE_L + r"sk_(?:live|test)_[0-9A-Za-z]{16,}" + EDGE_R),
    ("jwt", EDGE_L + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{7,}[A-Za-z0-9_]" + EDGE_R),
    ("private_key", r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----"),
    ("bearer_token", rf"(?i){EDGE_L}Bearer\s+[A-Za-z0-9._~+/=-]{{16,}}"),
)


def _record_kind(x: str) -> str:
    rest = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in CREDENTIALS)
    return f"CASE WHEN regexp_matches({x}, '{RECORD_EMAIL}') THEN 'email' WHEN {_any(x, RECORD_PHONES)} THEN 'phone' {rest} END"


view(
    "json_records",
    """
SELECT o_orderkey, CASE o_orderkey % 7
  WHEN 0 THEN '{"change_id":"c' || o_custkey || '","record_hash":"' || sha256(o_orderpriority) || '"}'
  WHEN 1 THEN '{"note":{"api_key":"x' || o_custkey || '"}}' WHEN 2 THEN '{"note":["sk-' || sha256(o_orderpriority) || '"]}'
  WHEN 3 THEN '{"token_hash":"13800138000138001380013800138000"}' WHEN 4 THEN '{"note":"call 13800138000"}'
  WHEN 5 THEN '{"Set-Cookie":"a","clientSecret":"b"}' ELSE '{"status":"' || o_orderstatus || '","total":' || CAST(o_custkey AS STRING) || '}' END AS record
FROM orders
""",
)
_KEYS = r"""regexp_extract_all(record, '"([^"\\]*)"\s*:', 1)"""
_DIGEST = (
    r'(?i)"(?:[^"]*[_-])?(?:hash|sha(?:1|224|256|384|512)?|digest|checksum|changes_head|reviews_head)(?:[_-][^"]*)?"'
    r'\s*:\s*"[0-9a-f]{32,128}"'
)


@query(
    "b5_record_scan",
    with_views("json_records", "all_texts")
    + f"""SELECT 'record-' || o_orderkey AS source, CASE WHEN len(list_filter({_KEYS}, lambda k: regexp_matches(k, '(?i){privacy.SENSITIVE_KEY}'))) > 0
        THEN 'sensitive_key' ELSE {_record_kind("rest")} END AS kind
      FROM (SELECT *, regexp_replace(record, '{_DIGEST}', '""', 'g') AS rest FROM json_records) t
      UNION ALL SELECT text_id, {_record_kind("text")} FROM all_texts""",
)
def b5(spark, sf):
    records = load_view(spark, sf, "json_records").select(
        F.concat(F.lit("record-"), F.col("o_orderkey").cast("string")).alias("source"),
        privacy.record_json_kind(F.col("record")).alias("kind"),
    )
    texts = load_view(spark, sf, "all_texts").select(
        F.col("text_id").alias("source"), privacy.record_text_kind(F.col("text")).alias("kind")
    )
    return records.unionByName(texts)


PAYLOAD_PHONES = (
    r"(?:^|[^0-9])(?:\+?86[-\s]?)?1[3-9][0-9]{9}(?:[^0-9]|$)",
    r"(?:^|[^0-9A-Za-z_])(?:\+[0-9]{1,3}[\s.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\s.-][0-9]{3,4}[\s.-][0-9]{3,4}(?:[^0-9A-Za-z_]|$)",
)


def _payload_kind(x: str) -> str:
    creds = (
        r"(?:^|[^A-Za-z0-9])[A-Za-z]{0,12}sk-[A-Za-z0-9_-]{16,}",
        r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        r"(?i)(?:api[_ -]?key|access[_ -]?token|secret|password|authorization)\s*[:=]\s*[^\s,;]{6,}",
    )
    email = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?:[^0-9A-Za-z_.-]|$)"
    return (
        f"CASE WHEN regexp_matches({x}, '{email}') THEN 'email' WHEN {_any(x, PAYLOAD_PHONES)} THEN 'phone' "
        f"WHEN regexp_matches({x}, '(?:^|[^0-9])[0-9]{{17}}[0-9Xx](?:[^0-9]|$)') THEN 'resident_id' "
        f"WHEN {_any(x, creds)} THEN 'credential' END"
    )


_SNAKE = r"""regexp_replace(regexp_replace(lower(regexp_replace(trim(k), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"""
_FIELD = f"({_SNAKE} IN ({', '.join(repr(f) for f in privacy.PAYLOAD_FIELDS)}) OR " + " OR ".join(
    f"suffix({_SNAKE}, '{s}')" for s in privacy.PAYLOAD_FIELD_SUFFIXES
) + ")"


@query(
    "b6_payload_scan",
    with_views("json_records", "all_texts")
    + f"""SELECT 'record-' || o_orderkey AS source, CASE WHEN len(list_filter({_KEYS}, lambda k: {_FIELD})) > 0
        THEN 'credential_field' ELSE {_payload_kind("record")} END AS kind FROM json_records
      UNION ALL SELECT text_id, {_payload_kind("text")} FROM all_texts""",
)
def b6(spark, sf):
    records = load_view(spark, sf, "json_records").select(
        F.concat(F.lit("record-"), F.col("o_orderkey").cast("string")).alias("source"),
        privacy.payload_json_kind(F.col("record")).alias("kind"),
    )
    texts = load_view(spark, sf, "all_texts").select(
        F.col("text_id").alias("source"), privacy.payload_text_kind(F.col("text")).alias("kind")
    )
    return records.unionByName(texts)


@query(
    "b7_gate_policy",
    with_views("all_texts")
    + f"""SELECT coalesce('query:' || kind, 'clean') AS outcome, count(*) AS rows
    FROM (SELECT {_query_kind('text')} AS kind FROM all_texts) t GROUP BY ALL""",
)
def b7(spark, sf):
    """One pass over the texts; only the kind of refused rows is kept, never the text."""
    gated = gates.pii_gate(load_view(spark, sf, "all_texts"), query=F.col("text"))
    outcome = F.when(F.col("pii_kind").isNull(), F.lit("clean")).otherwise(F.concat_ws(":", "pii_field", "pii_kind"))
    return gated.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("rows"))
