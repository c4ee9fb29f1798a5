"""URL parts, joining and the two normal forms, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL split pattern, skipped schemes, tracking parameters.
URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SKIPPED_SCHEMES = ("mailto", "tel", "javascript", "data", "blob")
TRACKING_KEYS = ("gclid", "dclid", "fbclid", "msclkid", "yclid", "_gl")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 3)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 5)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""))


def is_http(url: Column) -> Column:
    return url.rlike("^(?i)https?://[^/?#]+")


def origin(url: Column) -> Column:
    """Scheme and host, with the port only when it is not the scheme's default."""
    port = F.regexp_extract(authority(url), ":([0-9]+)$", 1)
    default = (port == "") | ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    bare = F.regexp_replace(host(url), r"\.$", "")
    return F.concat(scheme(url), F.lit("://"), bare, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def _site(url_scheme: Column, url: Column) -> Column:
    port = F.regexp_extract(authority(url), ":([0-9]+)$", 1)
    drop = (
        (port == "")
        | ((url_scheme == "http") & (port == "80"))
        | ((url_scheme == "https") & (port == "443"))
    )
    return F.concat(url_scheme, F.lit("://"), host(url), F.when(drop, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def _tidy_path(raw_path: Column) -> Column:
    collapsed = F.regexp_replace(raw_path, "/{2,}", "/")
    return F.when(collapsed == "", F.lit("/")).otherwise(collapsed)


def _with_query(base: Column, query: Column) -> Column:
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def normalized(url: Column) -> Column:
    """Lower scheme and host, default port and fragment dropped, slashes collapsed, query kept."""
    return _let(url, lambda u: _with_query(F.concat(_site(scheme(u), u), _tidy_path(path(u))), query_string(u)))


def _form_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _form_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _is_tracking(pair: Column) -> Column:
    key = F.lower(_form_decode(F.substring_index(pair, "=", 1)))
    return key.startswith("utm_") | key.isin(*TRACKING_KEYS)


def business_query(query: Column) -> Column:
    """Query text without tracking parameters; the other parameters keep their order."""
    kept = F.filter(F.split(query, "&"), lambda pair: (pair != "") & ~_is_tracking(pair))
    encoded = F.transform(
        kept,
        lambda pair: F.concat(
            _form_encode(_form_decode(F.substring_index(pair, "=", 1))),
            F.lit("="),
            F.when(
                F.instr(pair, "=") > 0,
                _form_encode(_form_decode(F.regexp_replace(pair, "^[^=]*=", ""))),
            ).otherwise(F.lit("")),
        ),
    )
    return F.array_join(encoded, "&")


def crawl_form(url: Column) -> Column:
    """Crawl identity: scheme and authority lowered, tracking parameters and fragment dropped."""
    return _let(
        url,
        lambda u: _with_query(
            F.concat(scheme(u), F.lit("://"), F.lower(authority(u)), _tidy_path(path(u))),
            business_query(query_string(u)),
        ),
    )


def _drop_dots(raw_path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(raw_path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, part)),
    )
    ends_open = raw_path.rlike(r"/\.{1,2}$")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(ends_open & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def join_url(base: Column, ref: Column) -> Column:
    """Reference resolution against an absolute base."""

    def resolve(r: Column) -> Column:
        root = F.concat(scheme(base), F.lit("://"), authority(base))
        tail = F.concat(
            F.when(F.instr(r, "?") > 0, F.concat(F.lit("?"), query_string(r))).otherwise(F.lit("")),
            F.when(F.instr(r, "#") > 0, F.concat(F.lit("#"), fragment(r))).otherwise(F.lit("")),
        )
        folder = F.regexp_replace(_tidy_path(path(base)), "[^/]*$", "")
        return (
            F.when(scheme(r) != "", r)
            .when(r.startswith("//"), F.concat(scheme(base), F.lit(":"), r))
            .when(r == "", base)
            .when(path(r) == "", F.concat(root, path(base), tail))
            .when(r.startswith("/"), F.concat(root, _drop_dots(path(r)), tail))
            .otherwise(F.concat(root, _drop_dots(F.concat(folder, path(r))), tail))
        )

    return _let(F.trim(ref), resolve)


def resolve_link(base: Column, raw: Column) -> Column:
    """Absolute crawl URL of a link, NULL for blank, same-page and non-fetchable links."""
    text = F.trim(raw)
    skip = (text == "") | text.startswith("#") | scheme(text).isin(*SKIPPED_SCHEMES)
    return F.when(~skip, crawl_form(join_url(base, text)))


def landing_page(
    raw: Column,
    base: Column,
    *,
    force_https: bool = True,
    trailing_slash: str = "remove",
    strip_query: bool = True,
    strip_fragment: bool = True,
) -> Column:
    """Comparable landing-page URL: query and fragment dropped unless asked for; NULL when not http(s)."""
    resolved = join_url(base, raw)

    def shape(u: Column) -> Column:
        out_scheme = F.lit("https") if force_https else scheme(u)
        tidy = _tidy_path(path(u))
        if trailing_slash == "remove":
            tidy = F.when(tidy == "/", tidy).otherwise(F.regexp_replace(tidy, "/+$", ""))
        elif trailing_slash == "add":
            tidy = F.when(tidy == "/", tidy).otherwise(F.concat(F.regexp_replace(tidy, "/+$", ""), F.lit("/")))
        out = F.concat(_site(out_scheme, u), tidy)
        if not strip_query:
            out = _with_query(out, query_string(u))
        if not strip_fragment:
            out = F.when(fragment(u) == "", out).otherwise(F.concat(out, F.lit("#"), fragment(u)))
        return F.when(is_http(u), out)

    return F.when(F.trim(raw) != "", _let(resolved, shape))


def route_variants(url: Column) -> Column:
    """File-route spellings of one URL: with and without query, slash and ``index.html``."""

    def variants(u: Column) -> Column:
        site = F.concat(scheme(u), F.lit("://"), authority(u))
        p, q = path(u), query_string(u)
        alt = (
            F.when(p.endswith("/"), F.concat(p, F.lit("index.html")))
            .when(p.endswith("/index.html"), F.regexp_replace(p, "index\\.html$", ""))
            .when(~F.regexp_extract(p, "([^/]*)$", 1).rlike(r"[^.]\.[^.]*[^.]$"), F.concat(p, F.lit("/")))
        )
        listed = F.array(
            u, F.concat(site, p), _with_query(F.concat(site, alt), q), F.concat(site, alt)
        )
        return F.array_distinct(F.array_compact(listed))

    return _let(normalized(url), variants)
