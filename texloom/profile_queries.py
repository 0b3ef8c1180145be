"""Queries for settings, links, library items and picks: customers serve as owners, orders as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.operators import profiles
from texloom.queries import query, read


@query("SELECT c_custkey AS id, c_mktsegment AS model, c_custkey % 3 <> 0 AS has_api_key FROM customer")
def public_settings(spark, sf_dir):
    """PR1."""
    key = F.when(F.col("c_custkey") % 3 != 0, "k").when(F.col("c_custkey") % 2 == 0, "")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("model"), key.alias("api_key"), F.lit("h").alias("extra_headers"))
    return profiles.public(c)


@query("""SELECT c_custkey AS provider, coalesce(any_value(o.url), 'https://preset') AS base_url, coalesce(any_value(o.model), c_mktsegment) AS model, coalesce(any_value(o.k), '') <> '' AS has_api_key, count(o.o_custkey) > 0 AS saved
FROM customer LEFT JOIN (SELECT o_custkey, 'https://' || arg_max(o_orderkey, o_orderkey) AS url, arg_max(o_orderpriority, o_orderkey) AS model, arg_max(CASE WHEN o_orderkey % 2 = 0 THEN 'k' ELSE '' END, o_orderkey) AS k FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def provider_options(spark, sf_dir):
    """PR7."""
    presets = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("provider"), F.lit("https://preset").alias("base_url"), F.col("c_mktsegment").alias("model"))
    saved = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("provider"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("https://"), F.col("o_orderkey").cast("string")).alias("base_url"), F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderkey") % 2 == 0, "k").otherwise("").alias("api_key"))
    return profiles.options(presets, saved)


@query("""WITH c AS (SELECT c_custkey AS id, 'u' || c_custkey % 2 AS ou, CASE WHEN c_custkey % 3 > 0 THEN 'u' || c_custkey % 3 END AS nu, CASE WHEN c_custkey % 5 = 0 THEN 'new' END AS nk, c_custkey % 7 = 0 AS clear FROM customer), m AS (SELECT *, coalesce(nu, ou) AS base_url FROM c)
SELECT id, base_url, CASE WHEN nk IS NOT NULL THEN nk WHEN clear THEN '' WHEN base_url <> ou THEN CASE WHEN base_url = 'u2' THEN 'kept' ELSE '' END ELSE 'old' END AS api_key FROM m""")
def merged_settings(spark, sf_dir):
    """PR8."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    none = F.create_map().cast("map<string,string>")
    old = c.select(k.alias("id"), F.concat(F.lit("u"), (k % 2).cast("string")).alias("base_url"), F.lit("m").alias("model"), F.lit("old").alias("api_key"), none.alias("extra_headers"))
    new = c.select(k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("u"), (k % 3).cast("string"))).alias("base_url"), F.lit(None).cast("string").alias("model"), F.when(k % 5 == 0, "new").alias("api_key"), (k % 7 == 0).alias("clear_api_key"), none.alias("extra_headers"))
    saved = c.select(k.alias("id"), F.lit("u2").alias("base_url"), F.lit("kept").alias("api_key"), none.alias("extra_headers"))
    return profiles.merge(old, new, saved).select("id", "base_url", "api_key")


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(user_id AS VARCHAR) END AS id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN o.k IS NULL THEN 'missing' WHEN event_id % 4 > 0 AND o.t THEN 'reader' ELSE 'details' END AS opens
FROM events LEFT JOIN (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS t FROM orders GROUP BY 1) o ON o.k = user_id""")
def job_links(spark, sf_dir):
    """PR6."""
    u, n = F.col("user_id").cast("string"), F.col("event_id") % 4
    url = F.when(n == 0, F.concat(F.lit("http://h/?job="), u)).when(n == 1, F.concat(F.lit("http://h/?reader="), u, F.lit("#x"))).when(n == 2, F.concat(F.lit("http://h/?view=reader&job="), u)).otherwise("http://h/?job=a%20b")
    links = read(spark, sf_dir, "events").select("event_id", profiles.deep_link(url).alias("l")).select("event_id", "l.*")
    jobs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("translated"))
    return profiles.resolve_links(links, jobs).select("event_id", "id", F.when(F.col("id").isNotNull(), F.col("opens")).alias("opens"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents m WHERE m.doc_id % 7 = 0 AND m.lang = d.lang AND m.text = d.text)")
def authored_files(spark, sf_dir):
    """JN12."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return profiles.authored_files(d, d.where("doc_id % 7 = 0")).select("doc_id")


def _items(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.col("o_custkey").alias("parent_id"), (F.col("o_orderstatus") == "P").alias("deleted"))
    return o.unionByName(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(False).alias("deleted")))


@query("""WITH i AS (SELECT o_orderkey + 1000000000 AS id, o_custkey AS parent_id, o_orderstatus = 'P' AS deleted FROM orders UNION ALL SELECT c_custkey, NULL, false FROM customer)
SELECT a.id, coalesce(a.parent_id, a.id) AS parent, c.id AS child FROM i a JOIN i c ON c.parent_id = coalesce(a.parent_id, a.id) AND NOT c.deleted""")
def live_children(spark, sf_dir):
    """JN15: all items are asked for."""
    items = _items(spark, sf_dir)
    return profiles.live_children(items, items)


@query("""WITH s AS (SELECT o_orderkey AS id, printf('%04d.00001', o_custkey % 1000) AS base, o_orderkey % 5 AS k, o_orderkey % 3 AS originals, o_orderstatus = 'F' AS accepted FROM orders)
SELECT id, CASE WHEN k = 0 THEN base || 'v3' WHEN starts_with(base, '0') AND (originals = 0 OR accepted) THEN base || 'v2' END AS paper_id,
 CASE WHEN k = 0 THEN 'kept' WHEN NOT starts_with(base, '0') THEN 'conflict' WHEN originals > 0 AND NOT accepted THEN 'none' ELSE 'official' END AS state FROM s""")
def completed_sources(spark, sf_dir):
    """JN16."""
    base = F.format_string("%04d.00001", F.col("o_custkey") % 1000)
    o = read(spark, sf_dir, "orders")
    asked = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(base, F.lit("v3"))).otherwise(base).alias("paper_id"), F.lit(False).alias("official"), (F.col("o_orderkey") % 3).alias("originals"), F.lit("metadata").alias("evidence"), (F.col("o_orderstatus") == "F").alias("accepted"))
    known = o.select(base.alias("base")).distinct().where("base like '0%'").withColumn("version", F.concat("base", F.lit("v2")))
    return profiles.completed_sources(asked, known)


@query("""WITH t AS (SELECT o_custkey AS view, arg_min(o_orderkey % 17, o_orderkey) FILTER (o_orderstatus = 'P') AS t FROM orders GROUP BY 1)
SELECT view, (coalesce(t, 0) + coalesce(min(o_orderkey % 17) FILTER (o_orderkey % 17 > coalesce(t, 0)), coalesce(t, 0) + 1)) / 2.0 AS ordinal FROM orders JOIN t ON view = o_custkey GROUP BY view, t""")
def column_places(spark, sf_dir):
    """RK19."""
    o = read(spark, sf_dir, "orders")
    return profiles.midpoint_ordinals(o.select(F.col("o_custkey").alias("view"), F.col("o_orderkey").alias("position"), F.when(F.col("o_orderstatus") == "P", "title").otherwise("x").alias("key"), (F.col("o_orderkey") % 17).alias("ordinal")))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey // 1024 AS page, count(*) FILTER (o_orderpriority = '1-URGENT') AS n, any_value(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS size FROM orders GROUP BY 1, 2)
SELECT k, page, CASE WHEN n = 1 AND size % 2 = 0 AND size > 0 AND size <= 40000 THEN size END AS size FROM a""")
def release_asset(spark, sf_dir):
    """RK18: a release has the orders of a customer among 1,024 keys, so that its array is bounded."""
    name, base = F.lit("1-URGENT"), F.lit("https://r")
    url = F.concat(base, F.lit("/releases/download/v1/"), F.col("o_orderpriority"))
    asset = F.struct(F.col("o_orderpriority").alias("name"), F.lit("uploaded").alias("state"), F.when(F.col("o_orderkey") % 2 == 0, url).otherwise("https://x").alias("url"), F.col("o_orderkey").alias("size"))
    named = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.floor(F.col("o_orderkey") / 1024).alias("page")).agg(F.collect_list(asset).alias("assets"))
    return named.select("k", "page", profiles.only_asset(F.col("assets"), name, base, F.lit("v1"), 40_000)["size"].alias("size"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'pressed' WHEN 'view' THEN user_id || CASE user_id WHEN 1 THEN ' page' ELSE ' pages' END || ' seen' ELSE event_type END AS message, event_type AS kind FROM events""")
def localized_messages(spark, sf_dir):
    """PR4."""
    said = F.when(F.col("event_type") == "view", F.concat(F.lit("vu "), F.col("user_id").cast("string"), F.lit(" pages"))).otherwise(F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("event_id", F.struct(said.alias("message"), F.col("event_type").alias("kind")).alias("body"))
    return profiles.localized_payload(rows, {"click": "pressed"}, [(r"^vu (\d+) pages$", "$1 pages seen")]).select("event_id", "body.message", "body.kind")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id // 256 AS page, CAST(event_id % 50 / 50.0 AS DOUBLE) AS x, CAST(event_id % 7 / 10.0 AS DOUBLE) AS y, CAST(event_id % 4 / 60.0 AS DOUBLE) AS w, CAST(0.05 AS DOUBLE) AS h,
 row_number() OVER (PARTITION BY user_id, event_id // 256 ORDER BY event_id % 7, event_id % 50, event_id) AS n FROM events),
m AS (SELECT user_id, page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE)[]) AS l FROM e GROUP BY user_id, page
 UNION ALL SELECT m.user_id, m.page, e.n, CASE WHEN coalesce(f, 0) = 0 THEN list_append(l, {'x': e.x, 'y': e.y, 'width': e.w, 'height': e.h}) ELSE list_transform(l, lambda p, i: CASE WHEN i = f
   THEN {'x': least(p.x, e.x), 'y': p.y, 'width': greatest(p.x + p.width, e.x + e.w) - least(p.x, e.x), 'height': p.height} ELSE p END) END
  FROM m JOIN e ON e.user_id = m.user_id AND e.page = m.page AND e.n = m.n + 1,
  LATERAL (SELECT list_position(list_transform(l, lambda p: abs(p.y - e.y) < 0.002 AND abs(p.height - e.h) < 0.004 AND e.x <= p.x + p.width + 0.002 AND e.x + e.w >= p.x), true) AS f)),
z AS (SELECT user_id, page, unnest(l) AS r FROM m QUALIFY n = max(n) OVER (PARTITION BY user_id, page))
SELECT user_id, CAST(page AS BIGINT) AS page, r.x AS x, r.y AS y, r.width AS width, r.height AS height FROM z""")
def merged_rects(spark, sf_dir):
    """RK13: a page's marks are the events of a user among 256 ids, so that its array is bounded."""
    n = F.col("event_id")
    rect = F.struct((n % 50 / 50.0).alias("x"), (n % 7 / 10.0).alias("y"), (n % 4 / 60.0).alias("width"), F.lit(0.05).alias("height"))
    marks = read(spark, sf_dir, "events").groupBy("user_id", F.floor(n / 256).alias("page")).agg(F.array_sort(F.collect_list(F.struct("event_id", rect.alias("r")))).alias("m"))
    return marks.select("user_id", "page", F.explode(profiles.merged_rects(F.transform("m", lambda m: m["r"]))).alias("r")).select("user_id", "page", "r.*")
