"""Personal-data and credential detection as column expressions.

Every function returns a kind name or NULL; the matched text itself is never returned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchloom.functions import urls

# Search-query and page-URL patterns.
EMAIL = (
    r"(?i)(?<![A-Z0-9.!#$%&'*+/=?^_`{|}~-])[A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@"
    r"(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,63}(?![A-Z0-9.-])"
)
CHINA_MOBILE = r"(?U)(?<!\d)(?:\+?86[ -]?)?1[3-9]\d{9}(?!\d)"
INTERNATIONAL_PHONE = r"(?U)(?<!\w)\+\d(?:[ .()\-]*\d){7,14}(?!\d)"
NORTH_AMERICAN_PHONE = r"(?U)(?<!\d)(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)"
PHONE_WORD = (
    r"\b(?:(?:phone|mobile|cell)[ _-]*(?:number|no)|telephone|tel|whatsapp|wechat)\b|"
    r"(?:电话|手机号|手机号码|联系电话)"
)
PHONE_DIGITS = r"(?:\d[ .()\-]*){7,15}"
RESIDENT_ID = r"(?U)(?<!\d)(\d{17}[0-9Xx])(?!\w)"
RESIDENT_ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
RESIDENT_ID_CHECKS = "10X98765432"
ID_WORD = (
    r"(?:user|customer|client|contact|lead|account|record|order|opportunity|visitor|session)"
    r"[ _-]*(?:id|uuid|guid|token)|"
    r"gclid|msclkid|fbclid|passport|ssn|social[ -]*security|"
    r"用户(?:编号|id)?|客户(?:编号|id)?|联系人(?:编号|id)?|线索(?:编号|id)?|"
    r"身份证(?:号)?|护照(?:号)?"
)
AI_ID_WORD = (
    r"(?:user|customer|client|contact|lead|account|record|order|opportunity|visitor|session)"
    r"[ _-]*(?:id|uuid|guid|token)|gclid|dclid|msclkid|fbclid|yclid|_gl"
)
ID_VALUE = r"([A-Za-z0-9][A-Za-z0-9._:-]{5,127})"
SENSITIVE_PARAMETER = (
    r"(?i)^(?:email|e_mail|phone|mobile|telephone|address|ip|cookie|token|auth|"
    r"gclid|dclid|msclkid|fbclid|yclid|_gl|"
    r"(?:user|customer|client|contact|lead|account|record|order|opportunity|visitor|session)"
    r"[_-]?(?:id|uuid|guid|token))$"
)

# Stored-record and request-payload patterns.
RECORD_EMAIL = r"(?iU)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w.-])"
RECORD_CHINA_PHONE = r"(?U)(?<!\d)(?:\+?86[ -]?)?1[3-9]\d(?:[ -]?\d){8}(?!\d)"
RECORD_INTERNATIONAL_PHONE = r"(?U)(?<!\w)\+[1-9]\d(?:[ .()-]?\d){7,13}(?!\d)"
CREDENTIALS = (
    ("api_token", r"(?U)\bsk-[A-Za-z0-9_-]{16,}\b"),
    ("source_host_token", r"(?U)\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"),
    ("cloud_access_key", r"(?U)\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("search_api_key", r"(?U)\bAIza[0-9A-Za-z_-]{30,}\b"),
    ("payment_key", r"(?U)\bsk_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    ("jwt", r"(?U)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("private_key", r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----"),
    ("bearer_token", r"(?i)(?U)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}"),
)
SENSITIVE_KEY = (
    r"(?:^|[_-])(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth(?:orization)?|"
    r"bearer|client[_-]?secret|private[_-]?key|password|passwd|pwd|secret|session[_-]?id|"
    r"cookie)(?:$|[_-])"
)
HASH_KEY = r"(?:^|[_-])(?:hash|sha(?:1|224|256|384|512)?|digest|checksum)(?:$|[_-])"
PAYLOAD_CHINA_PHONE = r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)"
PAYLOAD_FORMATTED_PHONE = (
    r"(?<!\w)(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)|\d{2,4})[\s.-]\d{3,4}[\s.-]\d{3,4}(?!\w)"
)
PAYLOAD_EMAIL = r"(?i)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w.-])"
PAYLOAD_RESIDENT_ID = r"(?<!\d)\d{17}[0-9Xx](?!\d)"
PAYLOAD_API_KEY = r"(?<![A-Za-z0-9])[A-Za-z]{0,12}sk-[A-Za-z0-9_-]{16,}"
PAYLOAD_JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PAYLOAD_ASSIGNMENT = (
    r"(?i)(?:api[_ -]?key|access[_ -]?token|secret|password|authorization)\s*[:=]\s*[^\s,;]{6,}"
)
PAYLOAD_FIELDS = (
    "api_key",
    "apikey",
    "access_token",
    "refresh_token",
    "authorization",
    "password",
    "passwd",
    "secret",
    "client_secret",
    "private_key",
    "cookie",
    "set_cookie",
)
PAYLOAD_FIELD_SUFFIXES = ("_api_key", "_access_token", "_refresh_token", "_client_secret", "_password")


def valid_resident_id(value: Column) -> Column:
    """18 characters, a real birth date and the weighted check character."""
    digits = F.transform(F.split(F.substring(value, 1, 17), ""), lambda d: d.try_cast("int"))
    weights = F.array(*[F.lit(w) for w in RESIDENT_ID_WEIGHTS])
    total = F.aggregate(
        F.zip_with(digits, weights, lambda d, w: F.coalesce(d, F.lit(0)) * F.coalesce(w, F.lit(0))),
        F.lit(0),
        lambda acc, item: acc + item,
    )
    check = F.element_at(F.array(*[F.lit(c) for c in RESIDENT_ID_CHECKS]), total % 11 + 1)
    birth = F.try_to_timestamp(F.substring(value, 7, 8), F.lit("yyyyMMdd"))
    return value.rlike("^[0-9]{17}[0-9Xx]$") & birth.isNotNull() & (F.upper(F.substring(value, 18, 1)) == check)


def _tail_after(text: Column, word: str) -> Column:
    """Text after the first hit of ``word``; empty when there is none."""
    pattern = F.lit(f"(?iU)(?:{word})")
    hit = F.regexp_substr(text, pattern)
    start = F.regexp_instr(text, pattern) + F.length(hit)
    return F.coalesce(F.substring(text, start, F.length(text)), F.lit(""))


def _phone(text: Column) -> Column:
    return (
        text.rlike(CHINA_MOBILE)
        | text.rlike(INTERNATIONAL_PHONE)
        | text.rlike(NORTH_AMERICAN_PHONE)
    )


def _id_after_word(text: Column, word: str) -> Column:
    tail = _tail_after(text, word)
    return F.exists(F.regexp_extract_all(tail, F.lit(ID_VALUE), F.lit(1)), lambda v: v.rlike("[0-9]"))


def query_pii_kind(text: Column) -> Column:
    """First matching kind in a search query, NULL for clean text."""
    safe = F.coalesce(text, F.lit(""))
    digits = safe.rlike(r"(?U)\d")  # every kind but e-mail needs one
    return (
        F.when(safe.contains("@") & safe.rlike(EMAIL), F.lit("email"))
        .when(~digits, F.lit(None).cast("string"))
        .when(_phone(safe) | _tail_after(safe, PHONE_WORD).rlike(PHONE_DIGITS), F.lit("phone"))
        .when(
            F.exists(F.regexp_extract_all(safe, F.lit(RESIDENT_ID), F.lit(1)), valid_resident_id),
            F.lit("resident_id"),
        )
        .when(_id_after_word(safe, ID_WORD), F.lit("stable_id"))
    )


def _parameter_names(part: Column) -> Column:
    pairs = F.filter(F.split(part, "&"), lambda pair: pair != "")
    return F.transform(pairs, lambda pair: _decode_plus(F.substring_index(pair, "=", 1)))


def _decode_plus(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _decode_path(text: Column) -> Column:
    """Percent-decoding that leaves a plus sign alone."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _sensitive_parameter(url: Column) -> Column:
    names = F.concat(_parameter_names(urls.query_string(url)), _parameter_names(urls.fragment(url)))
    return F.exists(names, lambda name: F.trim(name).rlike(SENSITIVE_PARAMETER))


def page_pii_kind(url: Column) -> Column:
    """Kind found in a page URL's path, its query and fragment, or its parameter names."""
    safe = F.coalesce(url, F.lit(""))
    path_kind = query_pii_kind(_decode_path(urls.path(safe)))
    rest = _decode_plus(F.array_join(F.filter(F.array(urls.query_string(safe), urls.fragment(safe)), lambda p: p != ""), " "))
    return F.coalesce(
        F.when(path_kind != "stable_id", path_kind),
        query_pii_kind(rest),
        F.when(_sensitive_parameter(safe), F.lit("sensitive_parameter")),
    )


def ai_page_pii_kind(url: Column) -> Column:
    """Variant for AI-surface exports: path, query and fragment are read as one text."""
    safe = F.coalesce(url, F.lit(""))
    parts = F.array(urls.path(safe), urls.query_string(safe), urls.fragment(safe))
    whole = _decode_plus(F.array_join(F.filter(parts, lambda p: p != ""), " "))
    rest = _decode_plus(F.array_join(F.filter(F.slice(parts, 2, 2), lambda p: p != ""), " "))
    return (
        F.when(whole.rlike(EMAIL), F.lit("email"))
        .when(_phone(whole), F.lit("phone"))
        .when(_id_after_word(rest, AI_ID_WORD), F.lit("stable_id"))
        .when(_sensitive_parameter(safe), F.lit("sensitive_parameter"))
    )


def record_text_kind(text: Column) -> Column:
    """First sensitive kind in one stored text value."""
    kind = F.when(text.contains("@") & text.rlike(RECORD_EMAIL), F.lit("email")).when(
        text.rlike(RECORD_CHINA_PHONE) | text.rlike(RECORD_INTERNATIONAL_PHONE), F.lit("phone")
    )
    for name, pattern in CREDENTIALS:
        kind = kind.when(text.rlike(pattern), F.lit(name))
    return kind


def sensitive_key(name: Column) -> Column:
    return name.rlike("(?i)" + SENSITIVE_KEY)


def exempt_digest(name: Column, value: Column) -> Column:
    """A hexadecimal digest under a hash-like name is no secret."""
    named = name.rlike("(?i)" + HASH_KEY) | name.isin("changes_head", "reviews_head")
    return named & value.rlike("(?i)^[0-9a-f]{32,128}$")


def payload_text_kind(text: Column) -> Column:
    return (
        F.when(text.contains("@") & text.rlike(PAYLOAD_EMAIL), F.lit("email"))
        .when(text.rlike(PAYLOAD_CHINA_PHONE) | text.rlike(PAYLOAD_FORMATTED_PHONE), F.lit("phone"))
        .when(text.rlike(PAYLOAD_RESIDENT_ID), F.lit("resident_id"))
        .when(
            text.rlike(PAYLOAD_API_KEY) | text.rlike(PAYLOAD_JWT) | text.rlike(PAYLOAD_ASSIGNMENT),
            F.lit("credential"),
        )
    )


def payload_field(name: Column) -> Column:
    """Field names compared after camelCase and punctuation become single underscores."""
    snake = F.regexp_replace(F.trim(name), "([a-z0-9])([A-Z])", "$1_$2")
    snake = F.regexp_replace(F.regexp_replace(F.lower(snake), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    hit = snake.isin(*PAYLOAD_FIELDS)
    for suffix in PAYLOAD_FIELD_SUFFIXES:
        hit = hit | snake.endswith(suffix)
    return hit


def record_json_kind(text: Column) -> Column:
    """Scan one JSON record at any depth: key names first, then the text without exempt digests."""
    names = F.regexp_extract_all(text, F.lit(r'"([^"\\]*(?:\\.[^"\\]*)*)"\s*:'), F.lit(1))
    digest = (
        r'(?i)"(?:[^"]*[_-])?(?:hash|sha(?:1|224|256|384|512)?|digest|checksum|changes_head|reviews_head)'
        r'(?:[_-][^"]*)?"\s*:\s*"[0-9a-f]{32,128}"'
    )
    bare = F.regexp_replace(text, digest, '""')
    return F.when(F.exists(names, sensitive_key), F.lit("sensitive_key")).otherwise(
        F.coalesce(record_text_kind(bare), record_text_kind(decoded_strings(bare)))
    )


def decoded_strings(text: Column) -> Column:
    """The strings of a JSON text with their escapes resolved, a line each; NULL without escapes or where they are broken."""
    strings = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0))
    array = F.from_json(F.concat(F.lit("["), F.array_join(strings, ","), F.lit("]")), "array<string>")
    return F.when(F.contains(text, F.lit("\\")), F.array_join(array, "\n"))


def payload_json_kind(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(r'"([^"\\]*(?:\\.[^"\\]*)*)"\s*:'), F.lit(1))
    return F.when(F.exists(names, payload_field), F.lit("credential_field")).otherwise(
        F.coalesce(payload_text_kind(text), payload_text_kind(decoded_strings(text)))
    )
