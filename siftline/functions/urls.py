"""URL columns: domain and host keys, page predicates, query parameters and templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from siftline import constants as K
from siftline.functions.text import utrim

_AUTHORITY = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def _strip_www(c: Column) -> Column:
    return F.regexp_replace(c, r"^www\.", "")


def netloc(url: Column) -> Column:
    """Authority part as written (user info and port kept); empty when there is none."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def domain_key(url_or_host: Column) -> Column:
    """Lower-cased authority without ``www.``; a bare host is its own key."""
    s = F.lower(utrim(F.coalesce(url_or_host, F.lit(""))))
    return _strip_www(F.when(s.contains("://"), netloc(s)).otherwise(s))


def netloc_key(url: Column) -> Column:
    """Like :func:`domain_key` for full URLs only: a bare host gives the empty key."""
    return _strip_www(F.lower(netloc(F.coalesce(url, F.lit("")))))


def host_key(url: Column) -> Column:
    """Lower-cased host name: user info, port and ``www.`` dropped."""
    host = F.regexp_replace(F.lower(netloc(F.coalesce(url, F.lit("")))), r"^.*@", "")
    bare = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(
        F.substring_index(host, ":", 1)
    )
    return _strip_www(bare)


def is_root_page(url: Column) -> Column:
    """Home page or locale home: no query and a path of at most one short segment."""
    trimmed = F.regexp_replace(url_path(url), r"/+$", "")
    path = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    short = (slashes <= 1) & (F.length(path) <= 4)
    return (url_query(url) == "") & (short | path.isin(K.LOCALE_PATHS))


def is_search_page(url: Column) -> Column:
    return url_query(url).contains("=") | _contains_any(F.lower(url_path(url)), K.SEARCH_PATH_HINTS)


def detail_flag(url: Column) -> Column:
    """0 for list-like URLs, 1 for pages about one thing."""
    return F.when(_contains_any(F.lower(url), K.LIST_URL_HINTS), 0).otherwise(1)


def detail_length(url: Column) -> Column:
    return F.length(F.substring_index(F.lower(url), "?", 1))


def _decode(c: Column) -> Column:
    """Percent-decoding that leaves a stray ``%`` as it is."""
    escaped = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.url_decode(escaped)).otherwise(F.replace(c, F.lit("+"), F.lit(" ")))


def param_names(query: Column) -> Column:
    """Decoded parameter names in first-seen order; blank values count, empty pairs do not."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.array_distinct(F.transform(pairs, lambda p: _decode(F.substring_index(p, "=", 1))))


def has_hinted_param(query: Column) -> Column:
    """Whether any parameter name holds one of the hint words.

    The query is decoded as a whole, encoded delimiters masked first, so no list of names is needed.
    """
    masked = F.regexp_replace(query, "%(?:26|3[dD])", "_")
    return F.lower(F.regexp_replace(_decode(masked), "=[^&]*", "")).rlike("|".join(K.PARAM_HINTS))


def is_learnable_search_url(url: Column) -> Column:
    """Search URLs worth learning from: a hinted parameter or a search path."""
    path, query = url_path(url), url_query(url)
    shaped = query.rlike("[^&]") | path.contains("/zoeken") | F.lower(path).contains("/search")
    clear_path = path.rlike(r"(?i)/(zoeken|search|results?)/?")
    return url.startswith("http") & (domain_key(url) != "") & shaped & (clear_path | has_hinted_param(query))


def mentions_search(url: Column) -> Column:
    return F.lower(url).contains("zoeken") | F.lower(url).contains("search")


def search_template(url: Column, names: Column) -> Column:
    """Scheme, authority and path with the first parameters' values masked; no fragment."""
    path = url_path(url)
    masked = F.array_join(F.transform(F.slice(names, 1, K.TEMPLATE_PARAMS), lambda n: F.concat(n, F.lit("=…"))), "&")
    return F.concat(
        url_scheme(url),
        F.lit("://"),
        netloc(url),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(masked == "", F.lit("")).otherwise(F.concat(F.lit("?"), masked)),
    )


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
