"""Queries for matching, picks and small records: customers serve as parents, orders as items and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions import records
from texloom.operators import library, matching
from texloom.queries import query, read


def key():
    return F.col("o_orderkey")


def owner():
    return F.col("o_custkey")


def paper():
    return F.concat(F.format_string("%04d.00001v", owner() % 1000), (key() % 3 + 1).cast("string"))


PAPER_SQL = "printf('%04d.00001v', o_custkey % 1000) || (o_orderkey % 3 + 1)"
ITEM_SQL = f"i AS (SELECT o_custkey AS parent_id, o_orderkey AS item_id, {PAPER_SQL} AS paper_id, CASE WHEN o_orderkey % 2 = 0 THEN 'zh-hans' ELSE 'en' END AS language, o_orderstatus, o_orderkey AS k FROM orders)"
TRANSLATED_SQL = "t AS (SELECT * FROM i WHERE o_orderstatus = 'F' AND k % 4 <> 0 AND k % 5 <> 0)"


def _items(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(
        owner().alias("parent_id"), key().alias("item_id"), paper().alias("paper_id"), F.when(key() % 2 == 0, "zh-hans").otherwise("en").alias("language"),
        matching.is_pdf(key() % 5 != 0, F.when(key() % 3 == 0, "Application/PDF").otherwise("application/pdf")).alias("is_pdf"), F.when(F.col("o_orderstatus") == "F", "translated").otherwise("original").alias("artifact"), (key() % 4 != 0).alias("available"),
    )


@query("""SELECT o_orderkey AS item_id, o_orderkey % 3 <> 2 AS pdf, o_orderkey % 7 <> 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 5 = 0) AS translation, o_orderkey % 6 IN (1, 2) AS supplement FROM orders""")
def attachment_kinds(spark, sf_dir):
    """FP8."""
    kind = F.when(key() % 3 == 0, "application/pdf").when(key() % 3 == 1, "APPLICATION/PDF").otherwise("text/html")
    title = F.concat(F.when(key() % 4 == 0, " [Made] ").otherwise(""), F.when(key() % 6 == 1, "The Appendix").when(key() % 6 == 3, "Appendices").otherwise("A paper"))
    pdf = matching.is_pdf(F.lit(True), kind)
    made = matching.is_translation(title, F.when(key() % 7 == 0, "original"), F.when(key() % 5 == 0, "us"), "[made]", "us")
    extra = matching.is_supplement(title, F.when(key() % 6 == 2, "x-Slides.pdf"))
    return read(spark, sf_dir, "orders").select(key().alias("item_id"), pdf.alias("pdf"), made.alias("translation"), extra.alias("supplement"))


@query(f"""WITH {ITEM_SQL}, {TRANSLATED_SQL}, g AS (SELECT parent_id, paper_id, language, count(*) AS n, min(item_id) AS item_id FROM t GROUP BY ALL)
SELECT i.item_id AS request_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'found' ELSE 'none' END AS state, CASE WHEN n = 1 THEN g.item_id END AS item_id FROM i LEFT JOIN g ON g.parent_id = i.parent_id AND g.paper_id = i.paper_id AND g.language = i.language""")
def matching_translation(spark, sf_dir):
    """FP9: every order asks for a translation of its paper in its language."""
    items = _items(spark, sf_dir)
    return matching.matching_translation(items.select(F.col("item_id").alias("request_id"), "parent_id", "paper_id", "language"), items)


@query(f"""WITH {ITEM_SQL}, {TRANSLATED_SQL}, g AS (SELECT parent_id, paper_id, count(*) AS n, min(item_id) AS translated FROM t GROUP BY ALL)
SELECT c_custkey AS parent_id, -c_custkey AS original, translated FROM customer JOIN g ON g.parent_id = c_custkey AND g.paper_id = printf('%04d.00001v', c_custkey % 1000) || (c_custkey % 3 + 1) AND n = 1 WHERE c_custkey % 6 <> 0""")
def default_pairs(spark, sf_dir):
    """FP11."""
    c = F.col("c_custkey")
    sources = read(spark, sf_dir, "customer").select(c.alias("parent_id"), F.when(c % 6 != 0, -c).alias("original"), F.concat(F.format_string("%04d.00001v", c % 1000), (c % 3 + 1).cast("string")).alias("paper_id"))
    return matching.default_pairs(sources, _items(spark, sf_dir))


@query(f"""WITH {ITEM_SQL}, m AS (SELECT parent_id, k % 8 AS key, k % 2 AS fp, min(paper_id) AS a, max(paper_id) AS b FROM i WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT c_custkey AS parent_id, r.key AS key, CASE WHEN c_custkey % 9 = 0 THEN 'own' WHEN a = b AND c_custkey % 4 <> 0 THEN a END AS paper_id, CASE WHEN c_custkey % 9 = 0 THEN 'attachment' WHEN a = b AND c_custkey % 4 <> 0 THEN 'saved-binding' END AS evidence
FROM customer JOIN range(8) r(key) ON true LEFT JOIN m ON m.parent_id = c_custkey AND m.key = r.key AND m.fp = r.key % 2""")
def saved_bindings(spark, sf_dir):
    """JN11."""
    c = F.col("c_custkey")
    candidates = read(spark, sf_dir, "customer").select(c.alias("parent_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("key"), F.when(c % 9 == 0, "own").alias("paper_id"), F.when(c % 4 == 0, "9999.99999").when(c % 4 == 1, F.format_string("%04d.00001", c % 1000)).alias("expected_base"))
    markers = read(spark, sf_dir, "orders").select(owner().alias("parent_id"), F.when(F.col("o_orderstatus") == "F", "translated").otherwise("original").alias("artifact"), (key() % 8).alias("source_key"), (key() % 2).alias("source_fingerprint"), paper().alias("paper_id"))
    return matching.saved_bindings(candidates.withColumn("fingerprint", F.col("key") % 2), markers)


@query(f"""WITH {ITEM_SQL}, o AS (SELECT parent_id, k % 8 AS key, k, CASE WHEN k % 3 > 0 THEN paper_id END AS own FROM i WHERE o_orderstatus <> 'F'), t AS (SELECT * FROM i WHERE o_orderstatus = 'F'),
b AS (SELECT t.k, min(o.key) AS b FROM t JOIN o ON o.parent_id = t.parent_id AND o.key = t.k % 8 AND o.k % 5 = t.k % 5 AND coalesce(own = t.paper_id, true) GROUP BY t.k),
n AS (SELECT parent_id, own, count(*) AS n, min(key) AS key FROM o WHERE own IS NOT NULL GROUP BY ALL)
SELECT t.k AS item_id, CASE WHEN b.b IS NOT NULL THEN b.b WHEN n = 1 THEN n.key END AS original, CASE WHEN b.b IS NOT NULL THEN 'saved-binding' WHEN n = 1 THEN 'attachment' END AS evidence
FROM t LEFT JOIN b ON b.k = t.k LEFT JOIN n ON n.parent_id = t.parent_id AND n.own = t.paper_id""")
def originals_of(spark, sf_dir):
    """JN11: the original that belongs to each translation."""
    o = read(spark, sf_dir, "orders")
    candidates = o.where("o_orderstatus <> 'F'").select(owner().alias("parent_id"), (key() % 8).alias("key"), (key() % 5).alias("fingerprint"), F.when(key() % 3 > 0, paper()).alias("paper_id"))
    translations = o.where("o_orderstatus = 'F'").select(key().alias("item_id"), owner().alias("parent_id"), paper().alias("paper_id"), (key() % 8).alias("source_key"), (key() % 5).alias("source_fingerprint"))
    return matching.originals_of(translations, candidates)


@query("""WITH a AS (SELECT o_custkey AS p, o_orderkey % 5 AS k, min(o_orderkey) AS i FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT o_orderkey AS job_id, CASE WHEN i IS NULL THEN 'job:' || o_orderkey ELSE CAST(i AS VARCHAR) END AS original, i IS NULL AS imported FROM orders LEFT JOIN a ON p = o_custkey AND k = o_orderkey % 5 WHERE o_orderstatus = 'F'""")
def comparison_imports(spark, sf_dir):
    """UP8."""
    o = read(spark, sf_dir, "orders")
    both = [owner().alias("parent_id"), (key() % 5).alias("original_key")]
    return matching.comparison_imports(o.where("o_orderstatus = 'F'").select(key().alias("job_id"), *both), o.where("o_orderstatus = 'O'").select(key().alias("item_id"), *both))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY ALL) SELECT user_id, list(event_type ORDER BY place) AS "values" FROM f GROUP BY user_id""")
def ordered_distinct(spark, sf_dir):
    """AG2."""
    return library.ordered_distinct(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS "values" FROM orders GROUP BY 1""")
def key_sets(spark, sf_dir):
    """AG6."""
    return library.key_sets(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT l_orderkey AS job_id, arg_max('log-' || l_linenumber, l_suppkey % 3 * 100 - l_linenumber) AS path FROM lineitem GROUP BY 1")
def newest_log(spark, sf_dir):
    """RK4."""
    logs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("log-"), F.col("l_linenumber").cast("string")).alias("path"), (F.col("l_suppkey") % 3).alias("mtime"), F.col("l_linenumber").alias("priority"))
    return library.newest_log(logs)


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS batch FROM events")
def slot_batches(spark, sf_dir):
    """RK16."""
    return library.slot_batches(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""WITH d AS (SELECT user_id AS job, event_type AS id, event_id AS updated, user_id || '-' || event_id % 3 AS comment, event_id % 3 AS revision, event_id % 10 < 9 AS put FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job, id ORDER BY put DESC, updated DESC) AS r FROM d) WHERE r = 1)
SELECT job, id, comment, revision, updated FROM l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = job AND o_custkey || '-' || o_orderkey % 3 = comment AND CASE o_orderstatus WHEN 'F' THEN 'click' WHEN 'O' THEN 'view' ELSE 'error' END = id)""")
def annotation_drafts(spark, sf_dir):
    """SK7."""
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.col("user_id").alias("job"), F.col("event_type").alias("id"), F.concat_ws("-", F.col("user_id").cast("string"), (n % 3).cast("string")).alias("comment"), (n % 3).alias("revision"), n.alias("updated"))
    clears = read(spark, sf_dir, "orders").select(owner().alias("job"), F.when(F.col("o_orderstatus") == "F", "click").when(F.col("o_orderstatus") == "O", "view").otherwise("error").alias("id"), F.concat_ws("-", owner().cast("string"), (key() % 3).cast("string")).alias("comment"))
    return library.drafts(rows.where("updated % 10 = 9"), rows.where("updated % 10 < 9"), clears)


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderkey % 7 <> 0 AS paper, o_orderkey % 2 + 1 AS v, CASE o_orderkey % 3 WHEN 0 THEN 'R' || o_orderkey WHEN 1 THEN ' ' END AS remote, CASE WHEN o_orderkey % 5 > 1 THEN 'L' || o_orderkey END AS local FROM orders),
d AS (SELECT *, paper AND v <> 2 AS due FROM j)
SELECT id, CASE WHEN NOT due THEN 'old' WHEN trim(remote) <> '' THEN remote ELSE coalesce(local, 'old') END AS name, CASE WHEN NOT due THEN NULL WHEN trim(remote) <> '' THEN 'arxiv' WHEN local IS NOT NULL THEN 'latex' END AS title_source, CASE WHEN due THEN 2 ELSE v END AS title_version FROM d""")
def refreshed_titles(spark, sf_dir):
    """TX17."""
    text = lambda x: F.concat(F.lit(x), key().cast("string"))
    jobs = read(spark, sf_dir, "orders").select(key().alias("id"), F.when(key() % 7 != 0, "arxiv").otherwise("upload").alias("kind"), F.lit("old").alias("name"), (key() % 2 + 1).alias("title_version"), F.when(key() % 3 == 0, text("R")).when(key() % 3 == 1, " ").alias("remote_title"), F.when(key() % 5 > 1, text("L")).alias("local_title"))
    return library.refreshed_titles(jobs, 2)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'X: 1' END AS draft FROM customer")
def header_drafts(spark, sf_dir):
    """STR27: two forms of one endpoint, the same address, and another one."""
    n = F.col("c_custkey") % 3
    before = F.when(n == 0, "https://api.openai.com/v1/").otherwise("https://a.example/v1")
    after = F.when(n == 0, "https://api.openai.com/v1/chat/completions").when(n == 1, "https://a.example/v1").otherwise("https://b.example/v1")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), records.header_draft(before, after, F.lit("X: 1")).alias("draft"))


@query("SELECT p_partkey AS id, 'x ⟪P0000⟫ y⟪P0001⟫' AS masked, 'z ⟪P' || printf('%04d', p_partkey % 9) || '⟫ ⟪P' || printf('%04d', p_partkey % 90 + 10) || '⟫⟪P0007⟫' AS back FROM part")
def marker_maps(spark, sf_dir):
    """MP1."""
    k = F.col("p_partkey")
    masked = F.concat(F.format_string("x ⟪P%04d⟫ y", k % 90 + 10), F.format_string("⟪P%04d⟫", k % 9))
    rows = read(spark, sf_dir, "part").select(k.alias("id"), records.local_markers(masked).alias("l"))
    return rows.select("id", "l.masked", records.global_markers(F.lit("z ⟪P0001⟫ ⟪P0000⟫⟪P0007⟫"), F.col("l.originals")).alias("back"))


@query("SELECT event_id, event_id % 6 IN (0, 2, 3) AS again FROM events")
def capability_errors(spark, sf_dir):
    """EX8."""
    n = F.col("event_id") % 6
    param = F.when(n < 2, "temperature")
    code = F.when(n == 0, "unsupported_value").when(n == 1, "rate_limit")
    kind = F.when(n.isin(2, 3, 4), "invalid_request_error").otherwise("server_error")
    said = F.when(n == 2, "`temperature` is not supported with this model").when(n == 3, "This model only supports temperature = 1").when(n == 4, "temperature looks fine, the key is wrong").otherwise("Unsupported temperature")
    return read(spark, sf_dir, "events").select("event_id", records.default_temperature_required(kind, param, code, said).alias("again"))


@query("SELECT c_custkey AS id, c_nationkey AS status FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def job_lookup(spark, sf_dir):
    """FP3."""
    jobs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("status"))
    return library.get(jobs, jobs.agg(F.max("id")).first()[0])


@query("""WITH e AS (SELECT event_id, event_id % 330 * 1.0 AS t, 50.0 AS h, 1 + user_id % 3 AS n FROM events), f AS (SELECT *, t + h * 0.2 AS f, greatest(1, least(n, floor((t + h * 0.2) / 100) + 1)) AS p FROM e),
g AS (SELECT *, greatest((p - 1) * 100, least(p * 100, f)) AS x FROM f)
SELECT event_id, CAST(p AS INTEGER) AS page, round((x - (p - 1) * 100) / 100, 6)::DOUBLE AS fraction, round(greatest(0, least(1, (x - t) / h)), 6)::DOUBLE AS viewport,
 round(CASE WHEN p = 1 AND x = 0 AND greatest(0, least(1, (x - t) / h)) = 0 THEN 0 ELSE x - greatest(0, least(1, (x - t) / h)) * h END, 6)::DOUBLE AS scroll FROM g""")
def viewports(spark, sf_dir):
    """AR6: the view is captured and found again."""
    pages = F.transform(F.sequence(F.lit(1), (1 + F.col("user_id") % 3).cast("int")), lambda i: F.struct(i.alias("page"), ((i - 1) * 100.0).alias("top"), F.lit(100.0).alias("height")))
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 330 * 1.0).cast("double").alias("t"), pages.alias("pages"))
    view = e.withColumn("v", records.captured_view(F.col("pages"), F.col("t"), F.lit(50.0)))
    scroll = records.scroll_offset(F.element_at("pages", F.col("v.page")), F.col("v"), F.lit(50.0))
    return view.select("event_id", "v.page", F.round("v.fraction", 6).alias("fraction"), F.round("v.viewport", 6).alias("viewport"), F.round(scroll, 6).alias("scroll"))


@query("""SELECT p_partkey AS id, sha256(CASE WHEN p_partkey % 3 = 0 THEN 'draw ' || p_partkey ELSE '[{"key":"/A","value":"' || p_partkey % 5 || '"},{"key":"/W","value":"9"}]' || p_name END) AS signature FROM part""")
def artwork_signatures(spark, sf_dir):
    """HS3."""
    k = F.col("p_partkey")
    meta = F.create_map(F.lit("/W"), F.lit("9"), F.lit("/Length"), k.cast("string"), F.lit("/A"), (k % 5).cast("string"))
    signature = records.artwork_signature(F.when(k % 3 == 0, "/Form").otherwise("/Image"), F.concat(F.lit("draw "), k.cast("string")).cast("binary"), meta, F.col("p_name").cast("binary"))
    return read(spark, sf_dir, "part").select(k.alias("id"), signature.alias("signature"))
