"""The registered queries of the library, each with the SQL that it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import numbers, text, urls, variants
from millrace.functions.values import Values
from millrace.operators import endpoints, groups, intervals, joins, order, pages, sets, sketches, steps, trees, windows
from millrace.plans import stored
from millrace.sources import read
from millrace.sources.read import table
from millrace.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


TOP_ORDERS = """
site: shop
name: top-orders
args: {limit: {type: int, default: 20}}
columns: [rank, order, total, customer]
pipeline:
  - source: {table: orders, key: o_orderkey}
  - filter: item.o_orderstatus = 'O' AND item.o_totalprice > 100000
  - sort: {by: o_totalprice, order: desc}
  - limit: "${{ least(args.limit + 10, 50) }}"
  - join: {table: customer, left: o_custkey, right: c_custkey}
  - filter: item.c_name <> '' AND item.c_acctbal > 0
  - map: {rank: "${{ index + 1 }}", order: "${{ item.o_orderkey }}", total: "${{ item.o_totalprice }}", customer: "${{ upper(item.c_name) }}"}
  - limit: "${{ args.limit }}"
"""


@query("""
    WITH best AS (SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30),
    known AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM best JOIN customer ON o_custkey = c_custkey WHERE c_name <> '' AND c_acctbal > 0)
    SELECT CAST(rank AS BIGINT) AS rank, o_orderkey AS "order", o_totalprice AS total, upper(c_name) AS customer FROM known ORDER BY rank LIMIT 20""")
def flagship_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.run(spark, stored.parse(TOP_ORDERS), lambda name: table(spark, sf_dir, name))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def select_path_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return steps.map_rows(df, event_id=F.col("event_id"), k=steps.at_path(df, "props.k").cast("long"), missing=steps.at_path(df, "props.none.at").cast("string"))


@query("SELECT p_partkey AS key, CAST(ordinal - 1 AS INT) AS pos, w AS value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS ordinal FROM part)")
def select_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.struct(text.split(F.col("p_name"), " ").alias("words")).alias("data"))
    return steps.select_path(df, "data.words", keep=["key"])


@query("SELECT p_partkey AS key, 'Part ' || p_name || ' #' || p_size AS label, 'fixed' AS source, p_retailprice * 2 AS double_price FROM part")
def map_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    label = Values(df).text("Part ", F.col("p_name"), " #", F.col("p_size"))
    return steps.map_rows(df, key=F.col("p_partkey"), label=label, source="fixed", double_price=F.col("p_retailprice") * 2)


@query("SELECT p_partkey AS key, p_brand AS brand, p_size AS size FROM part WHERE p_size <> 0 AND p_name <> ''")
def map_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    nested = steps.map_rows(steps.keep(df, Values(df).truthy(F.col("p_size")) & Values(df).truthy(F.col("p_name"))), key=F.col("p_partkey"), it=F.struct("p_brand", "p_size"))
    return steps.map_rows(nested, key=F.col("key"), brand=steps.at_path(nested, "it.p_brand"), size=steps.at_path(nested, "it.p_size"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority > '2' AND NOT coalesce(nullif(o_totalprice, 0) > 200000, false) AND o_orderstatus <> 'P'""")
def filter_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    v = Values(df)
    return steps.keep(df, (F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") > "2") & ~v.greater(F.nullif("o_totalprice", F.lit(0)), F.lit(200000))).select("o_orderkey")


NULLED = "(SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS p FROM orders)"


def nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("p"))


@query(f"SELECT o_orderkey, p, CAST(row_number() OVER (ORDER BY p ASC NULLS LAST, o_orderkey) - 1 AS BIGINT) AS index FROM {NULLED}")
def sort_asc_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_position(nulled(spark, sf_dir), steps.sort_keys("p", tie=["o_orderkey"]))


@query(f"SELECT o_orderkey, p, CAST(row_number() OVER (ORDER BY p DESC NULLS FIRST, o_orderkey) - 1 AS BIGINT) AS index FROM {NULLED}")
def sort_desc_missing_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_position(nulled(spark, sf_dir), steps.sort_keys("p", True, ["o_orderkey"]))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.top(table(spark, sf_dir, "part"), "p_retailprice", "25", tie=["p_partkey"]).select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 30")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.page(table(spark, sf_dir, "part").orderBy("p_partkey"), 30, 10).select("p_partkey", "p_name")


@query("SELECT abs(c_acctbal) AS distance, c_custkey FROM customer ORDER BY 1, 2 LIMIT 15")
def sort_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.top(table(spark, sf_dir, "customer"), F.abs(F.coalesce(F.nullif("c_acctbal", F.lit(0)), F.lit(0))), 15, False, ["c_custkey"]).select(F.abs("c_acctbal").alias("distance"), "c_custkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_linenumber + l_orderkey AS BIGINT) AS plus, l_quantity - l_discount AS minus, l_quantity * l_tax AS times,
    CAST(l_linenumber AS VARCHAR) || '-' || l_returnflag AS joined, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS divided,
    CAST(l_orderkey % nullif(l_linenumber - 1, 0) AS BIGINT) AS remainder FROM lineitem""")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    v, c = Values(df), F.col
    return steps.map_rows(
        df, **{k: c(k) for k in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")}, plus=v.plus(c("l_linenumber"), c("l_orderkey")), minus=v.minus(c("l_quantity"), c("l_discount")),
        times=v.times(c("l_quantity"), c("l_tax")), joined=v.text(c("l_linenumber"), "-", c("l_returnflag")), divided=v.over(c("l_tax"), c("l_discount")),
        remainder=v.remainder(c("l_orderkey"), c("l_linenumber") - 1),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE o_orderstatus END AS chosen, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS either_,
    CASE WHEN o_custkey <> 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS both_, nullif(o_orderstatus, 'P') IS NULL AS is_null, o_orderstatus = 'F' AS is_f, false AS mixed FROM orders""")
def logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    v, c = Values(df), F.col
    return steps.map_rows(
        df, o_orderkey=c("o_orderkey"), chosen=v.choose(v.greater(c("o_totalprice"), F.lit(250000)), F.lit("big"), c("o_orderstatus")),
        either_=v.either(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")), both_=v.both(c("o_custkey"), c("o_orderpriority")),
        is_null=v.same(F.nullif("o_orderstatus", F.lit("P")), F.lit(None)), is_f=v.same(c("o_orderstatus"), F.lit("F")), mixed=v.same(c("o_orderkey"), c("o_orderstatus")),
    )


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(l_quantity, l_tax, 7.0) AS smallest, greatest(l_quantity, l_discount) AS largest, CAST(floor(l_extendedprice) AS BIGINT) AS f,
    CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(round(l_extendedprice) AS BIGINT) AS r, abs(l_tax - 0.04) AS a FROM lineitem""")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    v, c = Values(df), F.col
    return steps.map_rows(
        df, **{k: c(k) for k in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")}, smallest=v.smallest(c("l_quantity"), c("l_tax"), F.lit(7.0), c("l_returnflag")), largest=v.largest(c("l_quantity"), c("l_discount")),
        f=text.math_floor(c("l_extendedprice")), c=text.math_ceil(c("l_extendedprice")), r=text.math_round(c("l_extendedprice")), a=text.math_abs(c("l_tax") - 0.04),
    )


def scalar(name: str, of: str, key: str, build: Callable[[DataFrame], dict], sql: str | None, source: str | None = None) -> None:
    """Registers a query that maps a table's key and some expressions; ``source`` is what its SQL selects from, if not the table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of)
        return steps.map_rows(df, **{key: F.col(key)}, **build(df))

    run.__name__ = name
    query(sql and f"SELECT {key}, {sql} FROM {source or of}")(run)


c = F.col
scalar("f_default", "events", "event_id", lambda df: {"x": text.default(F.nullif("event_type", F.lit("view")), F.lit("none")), "z": text.default(c("value"), F.lit(1.0))}, "coalesce(nullif(event_type, 'view'), 'none') AS x, value AS z")
scalar("f_join", "part", "p_partkey", lambda df: {"x": text.join(F.array("p_brand", F.nullif("p_type", F.lit("SMALL")), c("p_size").cast("string")), "|")}, "p_brand || '|' || coalesce(nullif(p_type, 'SMALL'), 'null') || '|' || p_size AS x")
scalar("f_case", "documents", "doc_id", lambda df: {"u": text.upper(c("source")), "l": text.lower(c("lang"))}, "upper(source) AS u, lower(lang) AS l")
scalar("f_trim", "documents", "doc_id", lambda df: {"x": text.trim(F.concat(F.lit("\t \n"), "lang", F.lit("　 ")))}, "lang AS x")
scalar("f_truncate", "documents", "doc_id", lambda df: {"x": text.truncate(c("text"), 40)}, "CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS x")
scalar("f_replace", "part", "p_partkey", lambda df: {"x": text.replace(c("p_name"), "red", "crimson"), "between": text.replace(c("p_brand"), "", "-")}, "replace(p_name, 'red', 'crimson') AS x, '-' || array_to_string(string_split(p_brand, ''), '-') || '-' AS between")
scalar("f_keys", "part", "p_partkey", lambda df: {"x": text.join(Values(df).keys(F.struct("p_size", "p_brand")))}, "'p_brand,p_size' AS x")
scalar("f_length", "documents", "doc_id", lambda df: {"bytes": Values(df).length(c("text")), "members": Values(df).length(text.split(c("source"), "_")), "other": Values(df).length(c("n_chars"))}, "coalesce(strlen(text), 0) AS bytes, coalesce(len(string_split(source, '_')), 0) AS members, CAST(0 AS BIGINT) AS other")
scalar("f_first_last", "part", "p_partkey", lambda df: {"first": text.first(text.split(c("p_name"), " ")), "last": text.last(text.split(c("p_name"), " "))}, "string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last")
scalar("f_json", "part", "p_partkey", lambda df: {"x": Values(df).json(F.struct(F.col("p_size").alias("size"), F.nullif("p_brand", F.lit("Brand#2")).alias("brand"))), "t": Values(df).json(c("p_name"))}, "'{\"brand\":' || CASE WHEN p_brand = 'Brand#2' THEN 'null' ELSE '\"' || p_brand || '\"' END || ',\"size\":' || p_size || '}' AS x, '\"' || p_name || '\"' AS t")
scalar("f_slugify", "part", "p_partkey", lambda df: {"x": text.slugify(F.concat("p_name", F.lit(" & _ "), "p_brand", F.lit("!")))}, "replace(lower(p_name), ' ', '-') || '-' || replace(lower(p_brand), '#', '') AS x")
scalar("f_sanitize", "pages", "page_id", lambda df: {"x": text.sanitize(c("html"))}, "replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '') AS x")
scalar("f_strip_tags", "pages", "page_id", lambda df: {"x": text.unescape(text.strip_tags(c("html")))}, "replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS x")
scalar("f_collapse", "documents", "doc_id", lambda df: {"x": text.collapse(c("text"))}, "trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS x")
scalar("f_ext", "pages", "page_id", lambda df: {"x": text.ext(c("url"))}, "regexp_extract(url, '(\\.[^.]*)$', 1) AS x")
scalar("f_basename", "pages", "page_id", lambda df: {"x": text.basename(c("url"))}, "string_split(url, '/')[-1] AS x")
scalar("f_urlencode", "documents", "doc_id", lambda df: {"x": text.urlencode(c("text"))}, "coalesce(url_encode(text), 'null') AS x")
scalar("f_urldecode", "documents", "doc_id", lambda df: {"x": text.urldecode(text.urlencode(c("text")))}, "coalesce(text, 'null') AS x")
scalar("f_round", "lineitem", "l_orderkey", lambda df: {"l_linenumber": c("l_linenumber"), "l_partkey": c("l_partkey"), "l_suppkey": c("l_suppkey"), "r": text.rounded(c("l_extendedprice")), "c": text.ceiling(c("l_extendedprice")), "f": text.floor(c("l_extendedprice")), "a": text.absolute(c("l_tax") - 1)}, "l_linenumber, l_partkey, l_suppkey, round(l_extendedprice) AS r, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, abs(l_tax - 1) AS a")
scalar("f_string", "orders", "o_orderkey", lambda df: {"x": text.string(F.nullif("o_custkey", F.lit(7)))}, "coalesce(CAST(nullif(o_custkey, 7) AS VARCHAR), '') AS x")
scalar("f_int", "part", "p_partkey", lambda df: {"whole": Values(df).whole_number(c("p_size")), "double": Values(df).whole_number(c("p_retailprice")), "text": Values(df).whole_number(text.last(text.split(c("p_brand"), "#"))), "bad": Values(df).whole_number(c("p_name"))}, "CAST(p_size AS BIGINT) AS whole, CAST(0 AS BIGINT) AS double, CAST(string_split(p_brand, '#')[-1] AS BIGINT) AS text, CAST(0 AS BIGINT) AS bad")
scalar("f_float", "part", "p_partkey", lambda df: {"x": Values(df).double(text.last(text.split(c("p_brand"), "#"))), "bad": Values(df).double(c("p_name"))}, "CAST(string_split(p_brand, '#')[-1] AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS bad")
scalar("f_reverse", "part", "p_partkey", lambda df: {"x": text.reverse(c("p_name")), "l": text.join(text.reverse(text.split(c("p_name"), " ")))}, "reverse(p_name) AS x, array_to_string(list_reverse(string_split(p_name, ' ')), ',') AS l")
scalar("f_unique", "part", "p_partkey", lambda df: {"x": text.join(F.array_sort(text.unique(text.split(F.concat_ws(" ", "p_name", "p_name"), " "))))}, "array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS x")
scalar("f_split", "documents", "doc_id", lambda df: {"n": F.size(text.split(c("text"), ".")).cast("long")}, "CASE WHEN text IS NULL THEN NULL ELSE len(string_split(text, '.')) END AS n")
scalar("first_nonempty", "orders", "o_orderkey", lambda df: {"x": text.first_nonempty(F.nullif("o_orderstatus", F.lit("P")), F.lit(""), c("o_orderpriority"))}, "coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS x")
scalar("leading_names", "documents", "doc_id", lambda df: {"x": text.leading_names(text.split(c("text"), " "))}, "array_to_string(string_split(text, ' ')[1:3], ', ') || CASE WHEN len(string_split(text, ' ')) > 3 THEN ' et al.' ELSE '' END AS x")
scalar("keyword_labels", "part", "p_partkey", lambda df: {"x": text.labelled(c("p_name"), {"ring": "jewel", "red": "warm", "blue": "cold"}, "other")}, "CASE WHEN contains(p_name, 'ring') THEN 'jewel' WHEN contains(p_name, 'red') THEN 'warm' WHEN contains(p_name, 'blue') THEN 'cold' ELSE 'other' END AS x")
scalar("convert_suffixed", "events", "event_id", lambda df: {"x": numbers.suffixed(F.concat(c("user_id").cast("string"), F.when(c("user_id") % 2 == 0, "K").otherwise("m")))}, "user_id * CASE WHEN user_id % 2 = 0 THEN 1e3 ELSE 1e6 END AS x")
scalar("duration_text", "events", "event_id", lambda df: {"x": numbers.duration(c("event_id") * 3 + 50)}, "CASE WHEN event_id * 3 + 50 >= 3600 THEN ((event_id * 3 + 50) // 3600) || ':' || lpad(CAST(((event_id * 3 + 50) % 3600) // 60 AS VARCHAR), 2, '0') ELSE CAST((event_id * 3 + 50) // 60 AS VARCHAR) END || ':' || lpad(CAST((event_id * 3 + 50) % 60 AS VARCHAR), 2, '0') AS x")
scalar("epoch_dates", "events", "event_id", lambda df: {"a": numbers.epoch_date(F.unix_seconds(c("ts").cast("timestamp")), 8), "b": numbers.iso_date(c("ts").cast("string"))}, "strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS a, strftime(ts, '%Y-%m-%d') AS b")
scalar("format_sizes", "documents", "doc_id", lambda df: {"x": numbers.format_size(c("n_chars") * 999)}, "CASE WHEN n_chars * 999 > 1000000000 THEN printf('%.1f GB', n_chars * 999 / 1e9) WHEN n_chars * 999 > 1000000 THEN printf('%.1f MB', n_chars * 999 / 1e6) WHEN n_chars * 999 > 1000 THEN printf('%.1f KB', n_chars * 999 / 1e3) ELSE (n_chars * 999) || ' bytes' END AS x")
scalar("fixed_decimals", "part", "p_partkey", lambda df: {"x": numbers.fixed(c("p_retailprice") / 3, 2)}, "round(p_retailprice / 3, 2) AS x")

#: What an address tells an endpoint is for, up to the last resort.
TOLD = """CASE WHEN regexp_matches(lower(url), 'hot|popular|ranking|trending') THEN 'hot' WHEN contains(lower(url), 'search') THEN 'search' WHEN regexp_matches(lower(url), 'feed|timeline|dynamic') THEN 'feed'
        WHEN regexp_matches(lower(url), 'comment|reply') THEN 'comments' WHEN contains(lower(url), 'history') THEN 'history' WHEN regexp_matches(lower(url), 'profile|userinfo|/me') THEN 'me'
        WHEN regexp_matches(lower(url), 'favorite|collect|bookmark') THEN 'favorite' ELSE"""
IS_ID = "regexp_matches(s, '^[0-9]+$') OR (regexp_matches(s, '^[A-Za-z0-9]{8,}$') AND regexp_matches(s, '[0-9]') AND NOT (regexp_matches(s, '^[A-Z]') AND length(regexp_replace(s, '[^A-Z]', '', 'g')) > length(s) // 3 AND length(s) <= 12))"
scalar("url_pattern_command", "pages", "page_id", lambda df: {"x": urls.command_pattern(c("url"))}, f"""
    lower(regexp_extract(url, '^([^:]*://[^/?#]*)', 1)) || regexp_replace(array_to_string(list_transform(string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: CASE WHEN {IS_ID} THEN ':id' ELSE s END), '/'), '/$', '')
    || CASE WHEN regexp_matches(url, '^[^#]*[?][^#]') THEN '?' || array_to_string(list_sort(list_distinct(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1]))), '&') ELSE '' END
    || CASE WHEN contains(url, '#') THEN '#' || regexp_replace(regexp_extract(url, '#(.*)$', 1), '/$', '') ELSE '' END AS x""")
scalar("url_pattern_endpoint", "pages", "page_id", lambda df: {"x": urls.endpoint_pattern(c("url")), "p": text.join(urls.steady_parameters(c("url")))}, """
    lower(regexp_extract(url, '://([^/?#:]*)', 1)) || array_to_string(list_transform(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{id}' WHEN regexp_matches(s, '^[0-9A-Fa-f]{8,}$') THEN '{hex}' ELSE s END), '/')
    || CASE WHEN contains(url, '?') THEN '?' || array_to_string(list_sort(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1] || '={}')), '&') ELSE '' END AS x,
    CASE WHEN contains(url, '?') THEN array_to_string(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1]), ',') ELSE '' END AS p""")
scalar("site_names", "pages", "page_id", lambda df: {"x": urls.site_name(c("url")), "name": urls.capability_name(c("url"))}, """
    coalesce(nullif(regexp_replace(regexp_replace(CASE WHEN h[-1] IN ('uk', 'jp', 'cn', 'com') AND len(h) >= 3 THEN h[-3] ELSE h[-2] END, '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'site') AS x,
    """ + TOLD + """ coalesce(lower(regexp_replace(q[-1], '[^A-Za-z0-9]', '_', 'g')), 'data') END AS name""",
    """(SELECT *, list_filter(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.'), lambda s: s <> '' AND s <> 'www') AS h,
        list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^[0-9]+$') AND NOT regexp_matches(s, '^[0-9A-Fa-f]{8,}$')) AS q FROM pages)""")
scalar("url_templates", "pages", "page_id", lambda df: {"x": urls.templated(c("url")), "y": urls.with_parameters(c("url"), {"lang": F.lit("e n"), "none": F.lit(None).cast("string")})}, """
    regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=[^&]*', '\\1page=:page') AS x, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'lang=e%20n' AS y""")


@query("SELECT url AS download_url, 'media' AS download_type, string_split(string_split(url, '/')[-1], '?')[1] AS download_path, 'pending' AS download_status, page_id FROM pages")
def download_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.download_status(table(spark, sf_dir, "pages")).drop("url", "html")


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.lookup(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name", "c_acctbal")


@query("SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON s_nationkey = n_nationkey")
def lookup_left_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    return joins.lookup_or_key(table(spark, sf_dir, "supplier"), some, "s_nationkey", "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query("""SELECT e.event_id, p.event_id AS purchase, p.value AS price FROM (SELECT * FROM events WHERE event_type = 'view') e
    ASOF LEFT JOIN (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    views = df.where("event_type = 'view'").select("event_id", "user_id", "ts")
    marks = df.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase"), F.col("value").alias("price"))
    return joins.latest_before(views, marks, "ts", "at", ["purchase", "price"], ["user_id"], F.date_trunc("day", "ts")).select("event_id", "purchase", "price")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_shipdate = (SELECT min(l_shipdate) FROM lineitem WHERE l_returnflag = 'N')")
def nearest_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.at_least_value(table(spark, sf_dir, "lineitem"), "l_shipdate", F.col("l_returnflag") == "N").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT c_custkey, n, total, (SELECT count(*) FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1) AS in_region FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def enrich_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    counts, totals = orders.groupBy("c_custkey").agg(F.count("*").alias("n")), orders.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.max("o_totalprice").alias("total"))
    near = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(1).cast("long").alias("near"))
    joined = joins.enrich(table(spark, sf_dir, "customer"), [counts, totals], "c_custkey").join(near, "c_nationkey", "left")
    return joined.select("c_custkey", "n", "total", F.coalesce("near", F.lit(0)).alias("in_region"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def not_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_seen(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 450000").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.first_of_each(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def distinct_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.first_of_each(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], ["event_id"], True)


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS members, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P') AS status FROM orders GROUP BY 1""")
def group_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("s", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")))
    return groups.collect_group(df, ["o_custkey"], F.col("o_orderpriority"), {"status": ("s", "o_orderkey")}).withColumn("members", text.join(F.col("members")))


@query("SELECT p_brand, arg_min(p_name, (length(p_name), p_name)) AS shortest FROM part GROUP BY 1")
def group_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.shortest(table(spark, sf_dir, "part"), ["p_brand"], "p_name")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + l_discount + l_tax AS total, (l_quantity + l_discount + l_tax) / 3 AS mean FROM lineitem""")
def list_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("some", F.array("l_quantity", "l_discount", "l_tax"))
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", groups.list_sum(F.col("some")).alias("total"), groups.list_mean(F.col("some")).alias("mean"))


@query("SELECT o_custkey, o_orderkey AS best FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.best(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", "o_orderkey", "best")


@query("SELECT o_custkey, string_agg(o_orderstatus, ';' ORDER BY o_orderkey) AS history FROM orders GROUP BY 1")
def ordered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.ordered_text(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", ";", "history")


@query("SELECT p_partkey, 'p_size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.unpivot(table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT l_returnflag, count(*) FILTER (l_quantity > 30) AS many, count(*) FILTER (l_discount = 0) AS full_price FROM lineitem GROUP BY 1")
def count_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.count_where(table(spark, sf_dir, "lineitem"), ["l_returnflag"], many=F.col("l_quantity") > 30, full_price=F.col("l_discount") == 0)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.histogram(table(spark, sf_dir, "events"), "event_type")


@query("SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM lineitem QUALIFY rank <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return windows.top_of_each(df, ["l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 5)


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank FROM orders")
def rank_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return order.with_position(df, [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", (F.col("index") + 1).alias("rank"))


@query("""SELECT event_id, user_id, CAST(coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 14400 OR lag(event_type) OVER w = 'purchase' THEN 1 ELSE 0 END AS b
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def sessions_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return windows.gap_sessions(df, ["user_id"], ["ts", "event_id"], seconds, 14400, F.col("event_type") == "purchase", bucket=F.date_trunc("day", "ts")).select("event_id", "user_id", "session")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, s, k, s AS first, CAST(0 AS BIGINT) AS part FROM e WHERE k = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.s, e.k, CASE WHEN e.s - first > 86400 THEN e.s ELSE first END, part + CASE WHEN e.s - first > 86400 THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
    SELECT event_id, user_id, part FROM w""")
def sessions_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), "ts")
    return windows.span_sessions(df, ["user_id"], "at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 86400).select("event_id", "user_id", "part")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return sets.concat(df.where("o_orderstatus = 'F'"), df.where("o_totalprice > 300000")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sets.concat_distinct(df.where("o_orderstatus = 'F'"), df.where("o_totalprice > 300000"), keys=["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sets.fallback(df.where("o_totalprice < 0"), df.where("o_totalprice > 400000"), df).select("o_orderkey")


@query("SELECT o_custkey AS customer, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def explode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    nested = orders.select(F.col("o_custkey").alias("customer"), F.array(F.struct("parts")).alias("orders"))
    return sets.unnest(nested, "orders", "parts", keep=["customer"]).withColumnRenamed("value", "part")


@query("SELECT o_custkey AS customer FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def intersect_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer")
    return sets.in_all(df.where("o_orderstatus = 'F'").select("customer"), df.where("o_totalprice > 300000").select("customer"))


@query("SELECT o_custkey AS customer FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer")
    return sets.in_first_only(df.select("customer"), df.where("o_totalprice > 300000").select("customer"), df.where("o_orderstatus = 'P'").select("customer"))


@query("SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def nested_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part names of an order's lines, from lists in lists: a block for each line, a span for each word."""
    spans = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("text")))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    blocks = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", spans.alias("spans"))))
    return lines.groupBy("l_orderkey").agg(text.join_nested(blocks, "spans", "text").alias("names"))


def stored_query(name: str, steps_text: str, sql: str, tables: Callable[[SparkSession, str], Callable[[str], DataFrame]] | None = None) -> None:
    """Registers a query that is stored as YAML."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = tables(spark, sf_dir) if tables else lambda table_name: table(spark, sf_dir, table_name)
        return stored.run(spark, stored.parse(f"site: shop\nname: {name}\nargs: {{word: {{default: en}}, most: {{type: int, default: 12}}}}\npipeline:\n{steps_text}"), own)

    run.__name__ = name
    query(sql)(run)


stored_query("stored_filters", """
  - source: {table: part, key: p_partkey}
  - filter: item.p_size % 2 && !(item.p_name | split(' ') | first | replace('red', '')) || item.p_size > 40
  - map: {key: "${{ item.p_partkey }}", slug: "${{ item.p_name | upper | slugify | truncate(args.most) }}", label: "No. ${{ item.p_size | string }}: ${{ item.p_brand | replace('Brand#', '') | int }}", words: "${{ item.p_name | split(' ') | reverse | join('+') }}", code: "${{ concat(item.p_brand, ' args.word') | urlencode }}"}""",
    """SELECT p_partkey AS key, CASE WHEN length(replace(lower(p_name), ' ', '-')) > 12 THEN substring(replace(lower(p_name), ' ', '-'), 1, 12) || '...' ELSE replace(lower(p_name), ' ', '-') END AS slug,
        'No. ' || p_size || ': ' || replace(p_brand, 'Brand#', '') AS label, array_to_string(list_reverse(string_split(p_name, ' ')), '+') AS words, replace(p_brand, '#', '%23') || '%20args.word' AS code
        FROM part WHERE (p_size % 2 <> 0 AND string_split(p_name, ' ')[1] = 'red') OR p_size > 40""")

stored_query("stored_truthy", """
  - source: {table: documents, key: doc_id}
  - filter: item.text && !item.source && !item.none || item.lang
  - map: {doc_id: "${{ item.doc_id }}", position: "${{ index }}"}""",
    "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position FROM documents WHERE (coalesce(text, '') <> '' AND coalesce(source, '') = '') OR coalesce(lang, '') <> ''",
    lambda spark, sf_dir: lambda name: table(spark, sf_dir, name).withColumn("none", F.lit(None)))

@query("SELECT p_partkey, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("m"))
    return sets.map_rows_of(df, "m", ["p_partkey"])


TREE = "(SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 7 END AS parent FROM part)"


SIZED = "(SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 7 END AS parent, p_size AS size FROM part)"


def sized_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 7)).alias("parent"), F.col("p_size").alias("size"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 7)).alias("parent"))


@query(f"WITH RECURSIVE t AS (SELECT id, parent, 0 AS depth FROM {TREE} WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, depth + 1 FROM {TREE} n JOIN t ON n.parent = t.id WHERE depth < 3) SELECT * FROM t")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.tree_levels(tree(spark, sf_dir), F.col("parent").isNull(), 3)


@query(f"""WITH RECURSIVE t AS (SELECT id, parent, size, row_number() OVER (PARTITION BY parent ORDER BY size DESC, id) AS r FROM {SIZED}),
    w AS (SELECT id, parent, size, 0 AS depth, [r] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, t.size, depth + 1, list_append(path, t.r) FROM t JOIN w ON t.parent = w.id)
    SELECT id, parent, size, depth, row_number() OVER (ORDER BY path) - 1 AS position FROM w""")
def tree_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.reading_order(sized_tree(spark, sf_dir), [F.desc("size")])


@query(f"""WITH RECURSIVE t AS (SELECT id, parent, size, row_number() OVER (PARTITION BY parent ORDER BY size DESC, id) AS r, count(*) OVER (PARTITION BY parent) AS n FROM {SIZED}),
    w AS (SELECT id, parent, size, 0 AS depth, [r] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, t.size, depth + 1, list_append(path, t.r) FROM t JOIN w ON t.parent = w.id WHERE t.r <= 3 AND depth < 2),
    c AS (SELECT parent AS id, count(*) AS n FROM t GROUP BY parent),
    h AS (SELECT w.*, CAST(coalesce(n, 0) - CASE WHEN depth = 2 THEN 0 ELSE least(coalesce(n, 0), 3) END AS BIGINT) AS hidden FROM w LEFT JOIN c ON w.id = c.id),
    u AS (SELECT id, parent, size, depth, hidden, CAST(NULL AS VARCHAR) AS note, path FROM h UNION ALL SELECT NULL, id, NULL, depth + 1, hidden, '[+' || hidden || ' more]', list_append(path, 1000000) FROM h WHERE hidden > 0)
    SELECT id, parent, size, depth, hidden, note, row_number() OVER (ORDER BY path) - 1 AS position FROM u""")
def tree_with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.reading_order(sized_tree(spark, sf_dir), [F.desc("size")], children=3, levels=3, more="note")


@query(f"""WITH t AS (SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY id DESC) AS r FROM {TREE}), a AS (SELECT id, parent, 0 AS depth FROM t WHERE parent IS NULL),
    b AS (SELECT t.id, t.parent, 1 AS depth FROM t JOIN a ON t.parent = a.id WHERE r <= 2), c AS (SELECT t.id, t.parent, 2 AS depth FROM t JOIN b ON t.parent = b.id WHERE r <= 2)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def topk_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_children(tree(spark, sf_dir), F.col("parent").isNull(), 2, 2, order=[F.desc("id")])


@query("""
    WITH lines AS (SELECT user_id, epoch_us(ts) AS time, 'line ' || event_id AS text FROM events WHERE event_type <> 'purchase'), ends AS (SELECT user_id, max(time) AS last FROM lines GROUP BY user_id)
    SELECT user_id, time, 1 AS kind, text FROM lines
    UNION ALL SELECT e.user_id, epoch_us(ts), 0, '[Chapter] ' || value FROM events e JOIN ends USING (user_id) WHERE event_type = 'purchase' AND epoch_us(ts) <= last""")
def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as headings before what the user did next."""
    df = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    marks = df.where("event_type = 'purchase'").withColumn("title", F.col("value").cast("string"))
    return joins.with_headings(df.where("event_type <> 'purchase'").withColumn("words", F.concat(F.lit("line "), "event_id")), marks, "at", "words", "at", "title", ["user_id"])


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log made of the pages, each answered by JSON that lists its own address parts."""
    items = F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.struct(F.concat(F.lit("title "), i).alias("title"), F.col("url").alias("link"), i.alias("likes")))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.lit("GET").alias("method"), F.create_map(F.lit("content-type"), F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("application/json")).alias("headers"),
        F.lit(None).cast("string").alias("body"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), F.to_json(F.struct(F.struct(items.alias("list")).alias("data"))).alias("response_body"),
    )


def log_tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: request_log(spark, sf_dir) if name == "requests" else table(spark, sf_dir, name)


stored_query("stored_intercept", """
  - intercept: {pattern: "blog*/${{ args.word }}/", collect: true}
  - map: {page_id: "${{ item.page_id }}", status: "${{ item.status }}"}""",
    "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status FROM pages WHERE regexp_matches(url, 'blog.*/en/')", log_tables)

stored_query("stored_collect", """
  - intercept: {pattern: "/en/", collect: false}
  - collect: {schema: "data struct<list:array<struct<title:string,link:string,likes:int>>>", select: data.list}
  - map: {place: "${{ item.pos }}", title: "${{ item.title | upper }}", link: "${{ item.link }}"}""",
    "SELECT CAST(i AS INT) AS place, 'TITLE ' || i AS title, url AS link FROM pages, range(3) r(i) WHERE contains(url, '/en/')", log_tables)


@stored.function("lengths of pages")
def page_lengths(run: stored.Run, df: DataFrame, what: dict) -> DataFrame:
    return df.select("page_id", (F.length("html") * what.get("times", 1)).cast("long").alias("size"))


stored_query("stored_evaluate", """
  - source: pages
  - evaluate: {function: lengths of pages, times: 2}
  - filter: item.size""", "SELECT page_id, CAST(length(html) * 2 AS BIGINT) AS size FROM pages WHERE length(html) > 0")

stored_query("stored_snapshot", """
  - source: pages
  - snapshot: {keys: [page_id], include_hidden: true}
  - filter: item.tag = 'title' || item.tag = 'h1'
  - group: {by: [page_id, tag], agg: {n: count(*)}}""",
    """SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\\b.*?</(script|style)>', '', 'g'), '(?i)<(title|h1)\\b', 1)) AS tag FROM pages) GROUP BY 1, 2""")

stored_query("stored_read", """
  - source: pages
  - read: {keys: [page_id]}
  - map: {page_id: "${{ item.page_id }}", lang: "${{ item.lang | default('none') }}"}""",
    "SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1), ''), 'none') AS lang FROM pages")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, 'blog.*/en/')")
def log_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.matching(request_log(spark, sf_dir), "blog*/en/").select("page_id", "url")


PROFILE = """
    WITH asked AS (SELECT page_id, url, regexp_matches(url, '[?&]page=') AS page,
        list_filter(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1]), lambda k: k <> '') AS names,
        list_transform(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{id}' WHEN regexp_matches(s, '^[0-9A-Fa-f]{8,}$') THEN '{hex}' ELSE s END) AS steps
        FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0),
    named AS (SELECT *, lower(regexp_extract(url, '://([^/?#:]*)', 1)) || array_to_string(steps, '/') || CASE WHEN len(names) > 0 THEN '?' || array_to_string(list_transform(list_sort(names), lambda k: k || '={}'), '&') ELSE '' END AS pattern FROM asked),
    firsts AS (SELECT *, 10 + 5 + 3 + 3 * 2 + 2 + CASE WHEN page THEN 2 ELSE 0 END AS score FROM named QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY page_id) = 1)"""


@query(PROFILE + """
    SELECT pattern, 'GET' AS method, url, CAST(score AS INT) AS score, 'data.list' AS item_path, CAST(3 AS BIGINT) AS item_count, 'likes,link,title' AS fields,
        'title=title,url=link,score=likes' AS roles, page AS has_paging, false AS has_search, 'cookie' AS strategy FROM firsts""")
def endpoint_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = endpoints.endpoints(request_log(spark, sf_dir), "page_id")
    shown = F.array_join(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select(
        "pattern", "method", "url", "score", F.col("response.item_path").alias("item_path"), F.col("response.item_count").alias("item_count"), F.array_join("response.fields", ",").alias("fields"),
        shown.alias("roles"), "has_paging", "has_search", "strategy",
    )


@query(PROFILE + """,
    best AS (SELECT *, row_number() OVER (ORDER BY score DESC, pattern) AS rank FROM firsts ORDER BY rank LIMIT 8),
    plain AS (SELECT *, list_filter(string_split(string_split(pattern, '?')[1], '/'), lambda s: s <> '' AND NOT starts_with(s, '{') AND NOT contains(s, '.'))[-1] AS plain,
        """ + TOLD + """ coalesce(lower(regexp_replace(list_filter(steps, lambda s: s <> '' AND s <> '{id}' AND s <> '{hex}')[-1], '[^A-Za-z0-9]', '_', 'g')), 'data') END AS name FROM best),
    again AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY rank) > 1 THEN name || '_' || coalesce(plain, CAST(rank - 1 AS VARCHAR)) ELSE name END AS name2 FROM plain),
    still AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY name2 ORDER BY rank) > 1 THEN name2 || '_' || rank ELSE name2 END AS name3 FROM again)
    SELECT CAST(rank AS INT) AS rank, name3 AS name, pattern, CAST(score AS INT) AS score, CAST(1.0 AS DOUBLE) AS confidence, 'cookie' AS strategy, 'title,url,score' AS columns,
        regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=[^&]*', '\\1page=:page') AS template FROM still""")
def endpoint_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = endpoints.capabilities(endpoints.endpoints(request_log(spark, sf_dir), "page_id"))
    return ranked.select("rank", "name", "pattern", "score", "confidence", "strategy", F.array_join("columns", ",").alias("columns"), "template")


@query("""
    WITH fields AS (SELECT event_type, key, CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE 'DOUBLE' END AS kind
        FROM events, unnest(json_keys(props)) k(key)),
    told AS (SELECT event_type, string_agg(key || ': ' || kind, ', ' ORDER BY key) AS inner_part FROM (SELECT DISTINCT event_type, key, kind FROM fields) GROUP BY event_type)
    SELECT event_type, n, 'OBJECT<' || inner_part || '>' AS props_schema FROM told JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) USING (event_type)""")
def variant_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = variants.variant(F.col("props"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), variants.merged_schema(props).alias("props_schema"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY key) - 1 AS INT) AS pos, key, CAST(json_extract(props, '$.' || key) AS BIGINT) AS value FROM events, unnest(json_keys(props)) k(key)")
def variant_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("held", variants.variant(F.col("props")))
    return variants.entry_rows(rows, "held", ["event_id"]).withColumn("value", F.try_variant_get("value", "$", "bigint"))


stored_query("stored_offset", """
  - source: {table: events, key: event_id}
  - sort: {by: value, order: desc}
  - offset: "${{ args.most * 50 }}"
  - map: {event: "${{ item.event_id }}", value: "${{ item.value }}", place: "${{ index }}"}""",
    "SELECT event_id AS event, value, r - 601 AS place FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events) WHERE r > 600")

stored_query("stored_missing", """
  - source: {table: customer, key: c_custkey}
  - filter: "!item.deleted && item.nothing[0].at IS NULL"
  - map: {key: "${{ item.c_custkey }}", title: "${{ item.title | default(args.word) }}", nick: "${{ item.profile.nick }}", label: "<${{ item.c_name.first }}>"}""",
    "SELECT c_custkey AS key, 'en' AS title, CAST(NULL AS VARCHAR) AS nick, '<>' AS label FROM customer")

stored_query("stored_order_ends", """
  - source: {table: orders, key: o_orderkey}
  - sort: {by: o_totalprice, order: desc}
  - limit: 500
  - map: {id: "${{ item.o_orderkey }}", total: "${{ item.o_totalprice }}", day: "${{ dayofyear(item.o_orderdate) }}"}
  - unpivot: {ids: [id], metrics: [total, day]}
  - sort: {by: value, tie: [id, metric]}
  - map: {id: "${{ item.id }}", metric: "${{ item.metric }}", value: "${{ item.value }}", place: "${{ index }}"}""",
    """WITH best AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500), u AS (
        SELECT o_orderkey AS id, 'total' AS metric, o_totalprice AS value FROM best UNION ALL SELECT o_orderkey, 'day', CAST(dayofyear(o_orderdate) AS DOUBLE) FROM best)
        SELECT id, metric, value, row_number() OVER (ORDER BY value, id, metric) - 1 AS place FROM u""")

LIMITED = """
site: shop
name: limited
timeout: 900
pipeline:
  - source: {table: nation, key: n_nationkey}
  - filter: item.n_regionkey > 1
  - map: {nation: "${{ item.n_name | lower }}"}
"""


@query("SELECT lower(n_name) AS nation FROM nation WHERE n_regionkey > 1")
def stored_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored query written within its own time limit, and read again."""
    path = order.shared_path(spark)
    stored.execute(spark, stored.parse(LIMITED), lambda name: table(spark, sf_dir, name), then=lambda df: df.write.parquet(path))
    return spark.read.parquet(path)


def streamed(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame], schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double") -> DataFrame:
    """What an operator over streams gives for all events, which arrive in three files; two rows of far later years come behind, so that all windows close."""
    path, rows = order.shared_path(spark), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).drop("props")
    late = [rows.limit(1).withColumns({"event_id": F.lit(-n).cast("long"), "ts": F.lit(f"{2090 + n}-01-01").cast("timestamp"), "user_id": F.lit(-1).cast("long"), "event_type": F.lit("late")}) for n in (1, 2)]
    for i, part in enumerate([*(rows.where(F.pmod(F.col("event_id"), F.lit(3)) == k) for k in range(3)), *late]):
        part.select("event_id", "ts", "user_id", "event_type", "value").coalesce(1 if i > 2 else 4).write.parquet(f"{path}/in/part={i}")
    stream = events.watch(spark, f"{path}/in/*", schema, files=4)
    events.drain(operator(stream), lambda df, i: df.write.mode("append").parquet(f"{path}/out"), f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, event_type, s, k, s AS start, event_id AS first FROM e WHERE k = 1 UNION ALL
        SELECT e.user_id, e.event_id, e.event_type, e.s, e.k, CASE WHEN e.s - w.s > 14400000000 OR w.event_type = 'purchase' OR e.s - w.start > 86400000000 THEN e.s ELSE w.start END,
            CASE WHEN e.s - w.s > 14400000000 OR w.event_type = 'purchase' OR e.s - w.start > 86400000000 THEN e.event_id ELSE w.first END
        FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
    SELECT user_id, first, start AS start_us, max(s) AS end_us, count(*) AS n FROM w GROUP BY ALL""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streamed(spark, sf_dir, lambda s: events.bounded_sessions(s, "ts", ["user_id"], "event_id", "400 days", 14400, 86400, F.col("event_type") == "purchase"))
    return found.where("first >= 0").select("user_id", "first", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""
    WITH marked AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 14400 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT user_id, us, sum(b) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM marked),
    spans AS (SELECT user_id, session, min(us) AS start, max(us) + 1 AS stop FROM numbered GROUP BY ALL),
    hours AS (SELECT DISTINCT epoch_us(date_trunc('hour', ts)) AS start, epoch_us(date_trunc('hour', ts)) + 3600000000 AS stop FROM events)
    SELECT h.start AS hour_us, count(*) AS sessions, CAST(sum(least(h.stop, s.stop) - greatest(h.start, s.start)) AS BIGINT) AS covered_us FROM spans s JOIN hours h ON s.start < h.stop AND h.start < s.stop GROUP BY h.start""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions each hour with events has, and for how long."""
    df = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    parted = windows.gap_sessions(df, ["user_id"], ["ts", "event_id"], F.col("us") / 1e6, 14400, bucket=F.date_trunc("day", "ts"))
    spans = order.materialized(parted.groupBy("user_id", "session").agg(F.min("us").alias("start"), (F.max("us") + 1).alias("stop")))  # read twice
    hour = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    hours = df.select(hour.alias("start"), (hour + 3_600_000_000).alias("stop")).distinct()
    pairs = intervals.overlapping(spans, hours, ("start", "stop"), ("start", "stop"), 3_600_000_000)
    covered = F.least("stop", "right_stop") - F.greatest("start", "right_start")
    return pairs.groupBy(F.col("right_start").alias("hour_us")).agg(F.count("*").alias("sessions"), F.sum(covered).cast("long").alias("covered_us"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streamed(spark, sf_dir, lambda s: events.counted(s, "ts", ["event_type"], "6 hours", "400 days"))
    return found.where("event_type <> 'late'").select("event_type", F.unix_micros("start").alias("start_us"), "n")


stored_query("stored_table_function", """
  - source: {table: part, key: p_partkey}
  - map: {id: "${{ item.p_partkey }}", text: "${{ concat(item.p_brand, ';', item.p_size, char(10), item.p_name, ';none') }}"}
  - table_function: {name: parse_lines, args: {text: "${{ item.text }}", columns: "word, n int", separator: ";"}}
  - map: {id: "${{ item.id }}", line: "${{ item.line }}", word: "${{ item.word }}", n: "${{ item.n }}"}""",
    "SELECT p_partkey AS id, CAST(0 AS BIGINT) AS line, p_brand AS word, CAST(p_size AS BIGINT) AS n FROM part UNION ALL SELECT p_partkey, 1, p_name, NULL FROM part")

stored_query("stored_table_argument", """
  - source: {table: events, key: event_id}
  - map: {id: "${{ item.event_id }}", user: "${{ item.user_id }}", us: "${{ unix_micros(CAST(item.ts AS TIMESTAMP)) }}"}
  - table_function: {name: number_sessions, partition: user, order: [us, id], args: {time: us, gap: 14400000000}}
  - sort: {by: id}""",
    """SELECT id, "user", us, CAST(coalesce(sum(b) OVER (PARTITION BY "user" ORDER BY us, id), 0) AS BIGINT) AS session FROM (
        SELECT event_id AS id, user_id AS "user", epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, body): a JSON body for each page, with a field that not all of them have."""
    page = F.regexp_extract("url", "[?&]page=([0-9]+)", 1)
    flags = F.struct(F.col("url").startswith("https").alias("secure"))
    data = F.struct(F.array(F.lit(1), F.lit(2)).alias("list"), F.length("html").alias("size"), flags.alias("flags"))
    body = F.to_json(F.struct(F.col("page_id").alias("id"), "url", F.when(page != "", page.cast("int")).alias("page"), data.alias("data")))
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), variants.variant(body).alias("body"))


@query("""
    WITH told AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, regexp_matches(url, '[?&]page=[0-9]') AS paged FROM pages)
    SELECT host, path, kind, count(*) AS n FROM told, (VALUES ('data', 'object'), ('data.flags', 'object'), ('data.flags.secure', 'boolean'), ('data.list', 'array'), ('data.size', 'number'), ('id', 'number'), ('page', 'number'), ('url', 'string')) f(path, kind)
    WHERE path <> 'page' OR paged GROUP BY ALL""")
def variant_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.field_profile(page_bodies(spark, sf_dir), "body", ["host"])


def archived(spark: SparkSession, sf_dir: str, split: int = 1 << 20) -> DataFrame:
    """The request log, written by Spark as an archive of JSON lines to the shared folder, and read again by ranges."""
    path = order.shared_path(spark)
    request_log(spark, sf_dir).withColumn("request_id", F.col("page_id")).drop("page_id").write.json(path)
    return read.archive(spark, path, split)


@query("""
    SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS n, sum(CAST(page_id % 5 = 0 AS INT)) AS images, CAST(sum(strlen(
        '{"data":{"list":[' || array_to_string(list_transform(range(3), lambda i: '{"title":"title ' || i || '","link":"' || url || '","likes":' || i || '}'), ',') || ']}}')) AS BIGINT) AS bytes
    FROM pages WHERE page_id % 7 <> 0 AND contains(url, '.example.') GROUP BY ALL""")
def archive_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of an archive by host; the conditions on url and status are tested while it is read."""
    log = archived(spark, sf_dir).where((F.col("status") == 200) & F.col("url").contains(".example."))
    image = (F.try_element_at("headers", F.lit("content-type")) == "image/png").cast("int")
    return log.groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.sum(image).alias("images"), F.sum(F.octet_length("response_body")).cast("long").alias("bytes"))


@query("SELECT event_type, count(*) AS n, true AS users_close, true AS median_close, true AS top_close FROM events GROUP BY event_type")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of every day, stored and merged by event type, held against exact numbers: each within its bound. Where no user stands out, the told count is 0."""
    df, path = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts")), order.shared_path(spark)
    sketches.states(df, ["event_type", "day"], ["user_id"], ["value"], ["user_id"]).write.parquet(path)
    whole = sketches.merged(spark.read.parquet(path), ["event_type"])
    told = whole.select(F.col("event_type").alias("type"), "rows", sketches.distinct_count("distinct_user_id").alias("users"), sketches.quantile("quantiles_value", 0.5).alias("median"), F.get(sketches.frequent_items("frequent_user_id", 1), F.lit(0)).alias("top"))
    pairs = df.join(order.materialized(told), F.col("event_type") == F.col("type"))
    by_user = pairs.groupBy("event_type", "user_id", "top").agg(F.count("*").alias("k"))
    most = by_user.groupBy("event_type").agg(F.count("*").alias("exact_users"), F.max("k").alias("most"), F.coalesce(F.max("top.count"), F.lit(0)).alias("told_most"))
    below = pairs.groupBy("event_type", "rows", "users").agg(F.sum((F.col("value") <= F.col("median")).cast("long")).alias("below"), F.count("*").alias("n"), F.sum((F.col("value") < F.col("median")).cast("long")).alias("under"))
    half = F.lit(0.5) * F.col("n")
    return below.join(most, "event_type").select(
        "event_type", F.col("rows").alias("n"), (F.abs(F.col("users") - F.col("exact_users")) <= 0.065 * F.col("exact_users")).alias("users_close"),
        ((F.col("below") >= half - 0.0265 * F.col("n")) & (F.col("under") <= half + 0.0265 * F.col("n"))).alias("median_close"), (F.abs(F.col("most") - F.col("told_most")) <= 1 + F.col("n") / sketches.ITEMS).alias("top_close"),
    )


@query()
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.articles(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("markdown", pages.markdown(F.col("title"), F.col("content")))


@query("""
    SELECT page_id, 'ul' AS container_tag, 'li > a' AS selector, CAST(len(regexp_extract_all(html, '<li><a href=')) AS BIGINT) AS n FROM pages WHERE len(regexp_extract_all(html, '<li><a href=')) > 1""")
def page_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path to the links of every page's menu. Elements are read many times, and parsed once."""
    elements = order.materialized(pages.snapshot(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "node", "parent", "tag", "class"))
    links = elements.where("tag = 'li'").select("page_id", F.col("node").alias("__li"))
    told = elements.join(links, (elements["page_id"] == links["page_id"]) & (elements["parent"] == links["__li"]), "left").select(elements["*"], F.col("__li").isNotNull().alias("listed"))
    return pages.path_selector(told, ["page_id"], F.col("listed") & (F.col("tag") == "a")).where("n > 1").select("page_id", "container_tag", "selector", "n")


@query()
def page_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.signatures(pages.snapshot(table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER v AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), v AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))
