"""Profiling of a request log: which endpoints it shows, what they return, and what they could serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import urls, variants

# The roles of fields, in order, and the names that tell them.
ROLES = {
    "title": ["title", "name", "text", "content", "desc", "description", "headline", "subject"],
    "url": ["url", "uri", "link", "href", "permalink", "jump_url", "web_url", "share_url"],
    "author": ["author", "username", "user_name", "nickname", "nick", "owner", "creator", "up_name", "uname"],
    "score": ["score", "hot", "heat", "likes", "like_count", "view_count", "views", "play", "favorite_count", "reply_count"],
    "time": ["time", "created_at", "publish_time", "pub_time", "date", "ctime", "mtime", "pubdate", "created"],
    "id": ["id", "aid", "bvid", "mid", "uid", "oid", "note_id", "item_id"],
    "cover": ["cover", "pic", "image", "thumbnail", "poster", "avatar"],
    "category": ["category", "tag", "type", "tname", "channel", "section"],
}
# Goals and the words that mean them, in order.
GOALS = {
    "search": ["search", "搜索", "查找", "query", "keyword"], "hot": ["hot", "热门", "热榜", "热搜", "popular", "top", "ranking"],
    "trending": ["trending", "趋势", "流行", "discover"], "feed": ["feed", "动态", "关注", "时间线", "timeline", "following"],
    "me": ["profile", "me", "个人信息", "myinfo", "账号"], "detail": ["detail", "详情", "video", "article", "view"],
    "comments": ["comments", "评论", "回复", "reply"], "history": ["history", "历史", "记录"], "favorite": ["favorite", "收藏", "bookmark", "collect"],
}


def read_bodies(df: DataFrame, body: str) -> DataFrame:
    """``df`` with ``response`` (item_path, item_count, fields, kinds) of the JSON in ``body``; null if it has no list of records.

    What counts is the longest list; ``fields`` and ``kinds`` are those of its first member. A body with a name twice in a
    record is no JSON for Spark, and none here.
    """
    found = df.withColumn("__list", variants.longest_list(variants.variant(F.col(f"`{body}`"))))
    first = F.get("__list.items", F.lit(0))
    response = F.struct(
        F.col("__list.path").alias("item_path"), F.size("__list.items").cast("long").alias("item_count"), variants.field_names(first).alias("fields"), variants.field_kinds(first).alias("kinds"),
    )
    return found.withColumn("response", F.when(F.col("__list").isNotNull(), response)).drop("__list")


def roles(fields: Column) -> Column:
    """map<role, field>: for each role the first field whose last name is the role itself, else the first with one of its names."""
    def field(role: str) -> Column:
        leaf = lambda f: F.lower(F.substring_index(f, ".", -1))
        exact = F.get(F.filter(fields, lambda f: leaf(f) == role), F.lit(0))
        return F.coalesce(exact, F.get(F.filter(fields, lambda f: leaf(f).isin(ROLES[role])), F.lit(0)))

    pairs = F.array(*[F.struct(F.lit(r).alias("role"), field(r).alias("field")) for r in ROLES])
    return F.map_from_entries(F.filter(pairs, lambda p: p["field"].isNotNull()))


def auth_signs(headers: Column) -> Column:
    """Which of bearer, csrf and signature the header names show."""
    keys = F.transform(F.map_keys(headers), F.lower)
    signs = [
        ("bearer", F.exists(keys, lambda k: k == "authorization")), ("csrf", F.exists(keys, lambda k: k.startswith("x-csrf") | k.startswith("x-xsrf"))),
        ("signature", F.exists(keys, lambda k: k.startswith("x-s") | (k == "x-t"))),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in signs]))


def strategy(signs: Column) -> Column:
    return F.when(F.array_contains(signs, "signature"), "intercept").when(F.size(signs) > 0, "header").otherwise("cookie")


def endpoints(log: DataFrame, order: str, least: int = 5) -> DataFrame:
    """Endpoints that a request log (url, method, headers, status, response_body) shows, scored; those below ``least`` are left out.

    Images, fonts, styles, scripts and errors don't count. Of the requests of one method and pattern the first, in
    ``order``, whose body holds a list of records stands for all, else the last with a body before it, else the first;
    an aggregate picks it. Score: JSON 10; a list of records 5, its members up to 10, 2 a role, less 3 if JSON is empty;
    an API path 3; search 3; paging 2; limit 2; status 200 2. confidence is score / 20, at most 1.
    """
    url = F.col("url")
    content = F.lower(F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit("")))
    rows = log.where((url != "") & F.coalesce(F.col("status") < 400, F.lit(True)) & ~content.rlike("image/|font/|css|javascript|wasm"))
    told = F.when(content != "", content).when(url.contains("/api/") | url.contains("/x/") | url.endswith(".json"), "application/json").otherwise("")
    rows = rows.select("url", "method", "headers", "status", "response_body", F.col(order).alias("__order"), told.alias("content_type"), urls.endpoint_pattern(url).alias("pattern"))
    read = read_bodies(rows, "response_body")
    rank = F.when(F.col("response").isNotNull(), F.struct(F.lit(0).alias("a"), F.col("__order").alias("b")))
    read = read.withColumn("__body", F.col("response_body").isNotNull()).drop("response_body")  # what a body says is read; bodies stay out of the shuffle
    rank = F.coalesce(rank, F.when(F.col("__body"), F.struct(F.lit(1).alias("a"), (-F.col("__order")).alias("b"))), F.struct(F.lit(2).alias("a"), F.col("__order").alias("b")))
    held = F.struct(*[F.col(c) for c in read.columns if c not in ("method", "pattern")])
    one = read.groupBy("method", "pattern").agg(F.min_by(held, rank).alias("__row")).select("method", "pattern", "__row.*").drop("__order")
    has = lambda names: F.arrays_overlap("query_params", urls.names(*names))
    one = one.withColumn("query_params", urls.steady_parameters(F.col("url")))
    one = one.withColumns({"has_search": has(urls.SEARCH), "has_paging": has(urls.PAGING), "has_limit": has(urls.LIMIT), "auth": auth_signs(F.col("headers")), "roles": roles(F.col("response.fields"))})
    is_json, answered = F.col("content_type").contains("json"), F.col("response").isNotNull()
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        points(is_json, 10) + points(answered, 5 + F.least(F.col("response.item_count"), F.lit(10)) + 2 * F.size("roles"))
        + points(F.col("pattern").contains("/api/") | F.col("pattern").contains("/x/"), 3) + points(F.col("has_search"), 3) + points(F.col("has_paging"), 2)
        + points(F.col("has_limit"), 2) + points(F.col("status") == 200, 2) - points(answered & is_json & (F.col("response.item_count") == 0), 3)
    )
    scored = one.withColumn("score", score.cast("int")).where(F.col("score") >= least)
    return scored.withColumns({"confidence": F.least(F.col("score") / 20, F.lit(1.0)), "strategy": strategy(F.col("auth"))}).drop("__body")


def capabilities(found: DataFrame, n: int = 8, goal: str | None = None) -> DataFrame:
    """The ``n`` best endpoints by score, then pattern, with unique names: a name that comes again gets the last plain path segment, else its rank."""
    best = found.orderBy(F.desc("score"), "pattern", "method").limit(n)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pattern", "method")))
    named = ranked.withColumn("name", F.lit(goal) if goal else urls.capability_name(F.col("url")))
    again = F.row_number().over(Window.partitionBy("name").orderBy("rank")) > 1
    plain = F.filter(F.split(F.substring_index("pattern", "?", 1), "/"), lambda s: (s != "") & ~s.startswith("{") & ~s.contains("."))
    named = named.withColumn("name", F.when(again, F.concat_ws("_", "name", F.coalesce(F.try_element_at(plain, F.lit(-1)), (F.col("rank") - 1).cast("string")))).otherwise(F.col("name")))
    still = F.row_number().over(Window.partitionBy("name").orderBy("rank")) > 1
    return named.withColumns({"name": F.when(still, F.concat_ws("_", "name", "rank")).otherwise(F.col("name")), "columns": recommended(F.col("roles"), F.col("response.fields")), "template": urls.templated(F.col("url"))})


def recommended(found: Column, fields: Column) -> Column:
    """Column names for an endpoint: its roles in order; with fewer than 3, more top-level fields that are no ids, up to 6; title and url if there is nothing."""
    known = F.filter(urls.names(*ROLES), lambda r: F.array_contains(F.map_keys(found), r))
    other = F.filter(F.coalesce(fields, F.array().cast("array<string>")), lambda f: ~F.lower(f).isin("_", "id", "mid", "uid", "cid", "oid", "rid") & ~f.contains("."))
    padded = F.slice(F.array_distinct(F.concat(known, other)), 1, 6)
    out = F.when(F.size(known) >= 3, known).otherwise(padded)
    return F.when(F.size(out) > 0, out).otherwise(urls.names("title", "url"))


def wanted(goal: str | None) -> str | None:
    """The goal that a wish in words means."""
    told = (goal or "").strip().lower()
    return next((name for name, words in GOALS.items() if told == name or any(w in told for w in words)), None) if told else None


def choose(candidates: DataFrame, goal: str | None = None) -> DataFrame:
    """Of (name, confidence, …) the one for the goal: named as it, else sharing its words, else the most confident; one row."""
    told, exact = (goal or "").strip().lower(), wanted(goal)
    name = F.lower("name")
    fit = [F.when(F.col("name") == (exact or ""), 0).when(name.contains(told) | F.lit(told).contains(name), 1).otherwise(2)] if told else []
    return candidates.orderBy(*fit, F.desc("confidence"), "name").limit(1)


def cascade(probes: DataFrame, key: str) -> DataFrame:
    """(key, strategy, confidence) from probe results (key, strategy, success): the simplest of public, cookie and header that works.

    confidence is 1, 0.9 or 0.8; if none works it is cookie with 0.3.
    """
    level = F.when(F.col("strategy") == "public", 0).when(F.col("strategy") == "cookie", 1).when(F.col("strategy") == "header", 2)
    best = probes.groupBy(key).agg(F.min(F.when(F.col("success"), level)).alias("level"))
    return best.select(key, F.coalesce(F.get(urls.names("public", "cookie", "header"), F.col("level")), F.lit("cookie")).alias("strategy"), F.coalesce(1.0 - F.col("level") * 0.1, F.lit(0.3)).alias("confidence"))
