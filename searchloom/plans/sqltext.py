"""Small SQL snippets shared by the checks."""

URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def squeeze(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[\s\x{{00A0}},]', '', 'g')"


def number(x: str) -> str:
    s = squeeze(x)
    return (
        rf"CASE WHEN regexp_matches({s}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') "
        rf"THEN try_cast({s} AS DOUBLE) END"
    )


def number_issue(x: str, blank: str) -> str:
    return (
        f"CASE WHEN {squeeze(x)} = '' THEN {blank} WHEN {number(x)} IS NULL THEN 'not_a_finite_number' "
        f"WHEN {number(x)} < 0 THEN 'negative' END"
    )


def date(x: str) -> str:
    formats = ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%m/%d/%Y", "%Y年%m月%d日")
    return "coalesce(" + ", ".join(f"try_strptime(trim({x}), '{f}')" for f in formats) + ")::DATE"


def url_part(x: str, group: int) -> str:
    return f"regexp_extract({x}, '{URL}', {group})"


def host(x: str) -> str:
    return f"lower(regexp_replace({url_part(x, 2)}, ':[0-9]*$', ''))"


def site(scheme: str, x: str) -> str:
    port = f"regexp_extract({url_part(x, 2)}, ':([0-9]+)$', 1)"
    return (
        f"({scheme} || '://' || {host(x)} || CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') "
        f"OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END)"
    )


def tidy_path(x: str) -> str:
    p = f"regexp_replace({url_part(x, 3)}, '/{{2,}}', '/', 'g')"
    return f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"


def normalized(x: str) -> str:
    q = url_part(x, 4)
    return (
        f"({site(f'lower({url_part(x, 1)})', x)} || {tidy_path(x)} || "
        f"CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END)"
    )


def origin(x: str) -> str:
    return site(f"lower({url_part(x, 1)})", x)


def crawl(x: str) -> str:
    tracking = "'gclid', 'dclid', 'fbclid', 'msclkid', 'yclid', '_gl'"
    kept = (
        f"list_filter(string_split({url_part(x, 4)}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') "
        f"AND lower(string_split(p, '=')[1]) NOT IN ({tracking}))"
    )
    q = f"array_to_string(list_transform({kept}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
    return (
        f"(lower({url_part(x, 1)}) || '://' || lower({url_part(x, 2)}) || {tidy_path(x)} || "
        f"CASE WHEN coalesce({q}, '') = '' THEN '' ELSE '?' || {q} END)"
    )


def join_url(base: str, x: str) -> str:
    """Reference joined to a literal base that ends in a slash."""
    root = "/".join(base.split("/")[:3])
    raw = (
        f"CASE WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {x} WHEN starts_with({x}, '//') THEN "
        f"'{base.split(':')[0]}:' || {x} WHEN starts_with({x}, '/') THEN '{root}' || {x} ELSE '{base}' || {x} END"
    )
    return rf"regexp_replace(replace({raw}, '/./', '/'), '/[^/]+/\.\./', '/')"


def r10(x: str) -> str:
    return f"round_even(({x})::DOUBLE, 10)"


def r12(x: str) -> str:
    return f"round_even(({x})::DOUBLE, 12)"
