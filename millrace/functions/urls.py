"""Addresses: canonical patterns, parameters, templates, site names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that change from request to request, and those that search, page and limit.
VOLATILE = [
    "_", "t", "ts", "timestamp", "cb", "callback", "nonce", "rand", "random", "spm_id_from", "vd_source", "from_spmid", "seid", "rt", "mid",
    "web_location", "platform", "w_rid", "wts", "sign",
]
SEARCH = ["q", "query", "keyword", "keywords", "search", "search_query", "w", "wd", "kw"]
PAGING = ["page", "pn", "p", "offset", "cursor", "next", "page_num", "pageNum"]
LIMIT = ["limit", "ps", "size", "pageSize", "page_size", "count", "num", "per_page"]
# Hosts with a site name of their own.
SITES = {
    "x.com": "twitter", "twitter.com": "twitter", "news.ycombinator.com": "hackernews", "www.zhihu.com": "zhihu", "www.bilibili.com": "bilibili",
    "search.bilibili.com": "bilibili", "www.v2ex.com": "v2ex", "www.reddit.com": "reddit", "www.xiaohongshu.com": "xiaohongshu",
    "www.douban.com": "douban", "www.weibo.com": "weibo", "www.bbc.com": "bbc",
}

HEAD = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"


def names(*some: str) -> Column:
    return F.array(*[F.lit(x) for x in some])


def host(url: Column) -> Column:
    """In lower case, without user and port; empty if there is no scheme."""
    return F.lower(F.regexp_extract(url, HEAD + r"(?:[^/?#@]*@)?([^/?#:]*)", 2))


def path(url: Column) -> Column:
    """``/`` if the address has none; empty without a scheme."""
    found = F.regexp_extract(url, HEAD + r"[^/?#]*([^?#]*)", 2)
    return F.when(url.rlike(HEAD) & (found == ""), "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def parameters(url: Column) -> Column:
    """array<struct<k, v>> in their order."""
    pieces = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))


def steady_parameters(url: Column) -> Column:
    """Names of the parameters that don't change from request to request."""
    return F.transform(F.filter(parameters(url), lambda p: ~p["k"].isin(VOLATILE)), lambda p: p["k"])


def is_id(segment: Column) -> Column:
    """All digits; or 8 or more ASCII letters and digits with a digit, unless it looks like a product code: 12 at most,
    a capital first and capitals for more than a third."""
    size = F.length(segment)
    capitals = size - F.length(F.regexp_replace(segment, "[A-Z]", ""))
    code = segment.rlike("^[A-Z]") & (capitals > F.floor(size / 3)) & (size <= 12)
    return segment.rlike("^[0-9]+$") | (segment.rlike("^[A-Za-z0-9]{8,}$") & segment.rlike("[0-9]") & ~code)


def clean_path(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, "/"), lambda s: F.when(is_id(s), ":id").otherwise(s)), "/")


def clean_query(x: Column) -> Column:
    pieces = F.filter(F.split(x, "&"), lambda p: p != "")
    return F.array_join(F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.substring_index(p, "=", 1)))), "&")


def _part(path_part: Column, query_part: Column) -> Column:
    names = clean_query(query_part)
    return F.concat(F.regexp_replace(clean_path(path_part), "/$", ""), F.when(names != "", F.concat(F.lit("?"), names)).otherwise(F.lit("")))


def command_pattern(url: Column) -> Column:
    """Scheme and host in lower case, id segments as ``:id``, sorted distinct parameter names, the fragment likewise.

    One trailing slash goes. Without a scheme the address before a fragment stays as it is.
    """
    main, has_fragment = F.regexp_extract(url, "^([^#]*)", 1), url.contains("#")
    fragment = F.regexp_extract(url, "^[^#]*#(.*)$", 1)
    head = F.lower(F.regexp_extract(main, r"^([^:]*://[^/?]*)", 1))
    rest = F.regexp_extract(main, r"^[^:]*://[^/?]*(.*)$", 1)
    cleaned = F.concat(head, _part(F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)))
    cleaned = F.when(main.rlike("^[^:]*://"), cleaned).otherwise(main)
    tail = _part(F.regexp_extract(fragment, r"^([^?]*)", 1), F.regexp_extract(fragment, r"^[^?]*\?(.*)$", 1))
    return F.when(has_fragment, F.concat(cleaned, F.lit("#"), tail)).otherwise(cleaned)


def endpoint_pattern(url: Column) -> Column:
    """Host and path with ``{id}``, ``{hex}`` and ``{bvid}`` for segments that vary, then the steady parameters as ``name={}``."""
    held = F.transform(
        F.split(path(url), "/"),
        lambda s: F.when(s.rlike("^[0-9]+$"), "{id}").when(s.rlike("^[0-9A-Fa-f]{8,}$"), "{hex}").when(s.rlike("^BV[A-Za-z0-9]{10}$"), "{bvid}").otherwise(s),
    )
    steady = F.array_join(F.transform(F.array_sort(steady_parameters(url)), lambda k: F.concat(k, F.lit("={}"))), "&")
    whole = F.concat(host(url), F.array_join(held, "/"), F.when(steady != "", F.concat(F.lit("?"), steady)).otherwise(F.lit("")))
    return F.when(url.rlike(HEAD), whole).otherwise(url)


def plain_name(x: Column) -> Column:
    """Lower case, ASCII letters and digits, others as ``-``, none at the ends; ``site`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]", "-"), "^-+|-+$", ""), F.lit("")), F.lit("site"))


def site_name(url: Column) -> Column:
    """The name of a known host, else the label before the top-level one (the one before that under uk, jp, cn and com)."""
    own = host(url)
    labels = F.filter(F.split(own, r"\."), lambda p: (p != "") & (p != "www"))
    n = F.size(labels)
    back = F.when(F.try_element_at(labels, F.lit(-1)).isin("uk", "jp", "cn", "com") & (n >= 3), 3).otherwise(2)
    other = plain_name(F.when(n >= 2, F.get(labels, n - back)).otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in SITES.items() for x in pair])
    return F.when(url.rlike(HEAD), F.coalesce(known[own], other)).otherwise("site")


def capability_name(url: Column) -> Column:
    """What an endpoint is for, told by words in its address, else its last path segment that isn't an id."""
    # The words that tell, in order of precedence.
    words = [
        ("hot", ["hot", "popular", "ranking", "trending"]), ("search", ["search"]), ("feed", ["feed", "timeline", "dynamic"]),
        ("comments", ["comment", "reply"]), ("history", ["history"]), ("me", ["profile", "userinfo", "/me"]), ("favorite", ["favorite", "collect", "bookmark"]),
    ]
    out = F
    for name, some in words:
        out = out.when(F.lower(url).rlike("|".join(some)), name)
    segments = F.filter(F.split(path(url), "/"), lambda s: (s != "") & ~s.rlike("^[0-9]+$") & ~s.rlike("^[0-9A-Fa-f]{8,}$"))
    last = F.lower(F.regexp_replace(F.try_element_at(segments, F.lit(-1)), "[^A-Za-z0-9]", "_"))
    return out.otherwise(F.coalesce(last, F.lit("data")))


def templated(url: Column, keyword: bool = True) -> Column:
    """The address with its search, limit and page values as parameters ``:keyword``, ``:limit`` and ``:page``; volatile ones go."""
    def one(p: Column) -> Column:
        value = F.when(p["k"].isin(SEARCH), ":keyword") if keyword else F.when(F.lit(False), "")
        return F.concat(p["k"], F.lit("="), value.when(p["k"].isin(LIMIT), ":limit").when(p["k"].isin(PAGING), ":page").otherwise(p["v"]))

    base = F.concat(F.lower(F.regexp_extract(url, HEAD, 1)), F.lit("://"), host(url), path(url))
    held = F.array_join(F.transform(F.filter(parameters(url), lambda p: ~p["k"].isin(VOLATILE)), one), "&")
    return F.when(url.rlike(HEAD), F.concat(base, F.when(held != "", F.concat(F.lit("?"), held)).otherwise(F.lit("")))).otherwise(url)


def with_parameters(url: Column, values: dict[str, Column]) -> Column:
    """``url`` with more parameters, encoded; null ones are left out."""
    from millrace.functions.text import urlencode

    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(k + "="), urlencode(v))) for k, v in values.items()]))
    mark = F.when(url.contains("?"), "&").otherwise("?")
    return F.when(F.size(pairs) > 0, F.concat(url, mark, F.array_join(pairs, "&"))).otherwise(url)


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` any text, ``?`` one character, others themselves."""
    return "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".+^${}()|[]\\" else c for c in glob)
