"""Queries over the driver's tables for the engine's operators, and their SQL.

orders serve as jobs, events as requests and changes, part keys as files of a graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texloom.functions import ids, records, response, text
from texloom.operators import align, graph, library, segments
from texloom.tex import frames, tokens

STATUS = "case o_orderstatus when 'F' then 'completed' when 'O' then 'partial' else case when o_orderkey % 3 = 0 then 'translating' else 'failed' end end"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for stages of Python: a table of fewer splits than cores is dealt out first."""
    d, cores = read(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return d if d.rdd.getNumPartitions() >= cores else d.repartition(cores)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("arxiv").alias("kind"), F.concat(F.lit("Paper "), "o_orderpriority").alias("name"), F.col("o_custkey").alias("source_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "zh-hans").otherwise("en").alias("language"), F.expr(STATUS).alias("status"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("check"))).otherwise(F.array().cast("array<string>")).alias("warnings"), (F.col("o_orderkey") % 7 != 0).alias("readable"),
        (F.col("o_orderkey") % 90).cast("int").alias("progress"), (F.col("o_orderkey") % 11).cast("int").alias("done"), (F.col("o_orderkey") % 13).cast("int").alias("total"),
        F.when(F.col("o_orderkey") % 4 == 0, "LaTeX error").when(F.col("o_orderkey") % 4 == 1, "API limit").when(F.col("o_orderkey") % 4 == 2, "").alias("error"), F.lit("no message").alias("message"),
    )


JOBS_SQL = f"""jobs AS (SELECT o_orderkey AS id, 'Paper ' || o_orderpriority AS name, o_custkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'zh-hans' ELSE 'en' END AS language,
 {STATUS} AS status, CAST(epoch(o_orderdate) AS BIGINT) AS created_at, o_orderkey % 5 = 0 AS warned, o_orderkey % 7 <> 0 AS readable,
 CAST(o_orderkey % 90 AS INTEGER) AS progress, o_orderkey % 11 AS done, o_orderkey % 13 AS total,
 CASE o_orderkey % 4 WHEN 0 THEN 'LaTeX error' WHEN 1 THEN 'API limit' WHEN 2 THEN '' END AS error FROM orders)"""

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {JOBS_SQL} SELECT id, created_at FROM jobs")
def library_listing(spark, sf_dir):
    """RK1."""
    return library.listing(jobs(spark, sf_dir)).select("id", "created_at")


@query(f"WITH {JOBS_SQL} SELECT id, name, status FROM jobs WHERE status IN ('completed', 'partial') AND contains(lower(name), 'urgent')")
def library_filter(spark, sf_dir):
    """FP1."""
    return library.library_filter(jobs(spark, sf_dir), "done", "URGENT").select("id", "name", "status")


@query(f"WITH {JOBS_SQL} SELECT count(*) FILTER (status IN ('completed', 'partial')) AS completed, count(*) FILTER (status = 'translating') AS running FROM jobs")
def status_counts(spark, sf_dir):
    """AG4."""
    return library.status_counts(jobs(spark, sf_dir))


@query(f"WITH {JOBS_SQL} SELECT count(*) FILTER (status <> 'translating') AS processed, count(*) FILTER (status = 'translating') AS remaining, count(*) FILTER (status = 'completed') AS completed FROM jobs")
def batch_report(spark, sf_dir):
    """AG3, SK5."""
    return library.batch_report(jobs(spark, sf_dir))


@query(f"WITH {JOBS_SQL} SELECT CASE WHEN status = 'translating' THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1")
def interrupted_jobs(spark, sf_dir):
    """SC1."""
    return library.coerce_interrupted(jobs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def _requests(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("arxiv").alias("kind"), F.col("c_custkey").alias("source_id"), F.when(F.col("c_nationkey") % 2 == 0, "zh-hans").otherwise("en").alias("language"))


REUSE_SQL = f"""{JOBS_SQL}, usable AS (SELECT *, greatest(CASE status WHEN 'completed' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, CASE WHEN warned THEN 1 ELSE 0 END) AS rank FROM jobs WHERE status = 'translating' OR (status IN ('completed', 'partial') AND readable)),
best AS (SELECT *, row_number() OVER (PARTITION BY source_id, language ORDER BY rank, created_at DESC, id) AS r FROM usable),
reuse AS (SELECT c_custkey AS request_id, b.id AS job_id, b.rank AS rank, b.status AS status FROM customer LEFT JOIN best b ON b.r = 1 AND b.source_id = c_custkey AND b.language = CASE WHEN c_nationkey % 2 = 0 THEN 'zh-hans' ELSE 'en' END)"""


@query(f"WITH {REUSE_SQL} SELECT request_id, job_id, rank FROM reuse")
def reusable_result(spark, sf_dir):
    """FP5, FP6, RK2."""
    return library.reusable(_requests(spark, sf_dir), jobs(spark, sf_dir))


def _keyed(spark, sf_dir):
    """Every event is a request with its user's key; every order has bound the key of its customer."""
    requests = read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("idempotency_key"), F.col("event_type").alias("fingerprint"))
    bound = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("idempotency_key"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("job_id"), F.expr(BOUND).alias("fingerprint"))
    return requests, bound


BOUND = "case o_orderstatus when 'F' then 'click' when 'O' then 'view' else 'error' end"
REPLAY_SQL = f"""first AS (SELECT o_custkey AS k, min(o_orderkey) AS job_id, arg_min({BOUND}, o_orderkey) AS fp FROM orders GROUP BY 1),
replay AS (SELECT event_id AS request_id, CASE WHEN fp IS NULL THEN 'new' WHEN fp = event_type THEN 'replay' ELSE 'conflict' END AS outcome, CASE WHEN fp = event_type THEN job_id END AS job_id FROM events LEFT JOIN first ON k = user_id)"""


@query(f"WITH {REPLAY_SQL} SELECT request_id, outcome, job_id FROM replay")
def replay_or_conflict(spark, sf_dir):
    """JN9, UP2."""
    return library.replay_or_conflict(*_keyed(spark, sf_dir))


@query(f"""WITH {REPLAY_SQL}, {REUSE_SQL}, d AS (SELECT p.request_id, p.outcome, p.job_id AS rj, u.job_id AS uj, u.status FROM replay p LEFT JOIN reuse u USING (request_id)),
a AS (SELECT *, CASE WHEN outcome IN ('conflict', 'replay') THEN outcome WHEN uj IS NULL THEN 'create' WHEN status = 'translating' THEN 'active' ELSE 'library' END AS action FROM d)
SELECT request_id, action, CASE action WHEN 'replay' THEN rj WHEN 'active' THEN uj WHEN 'library' THEN uj END AS job_id FROM a""")
def request_decision(spark, sf_dir):
    """UP4."""
    j = jobs(spark, sf_dir)
    return library.decide(library.replay_or_conflict(*_keyed(spark, sf_dir)), library.reusable(_requests(spark, sf_dir), j), j)


@query(f"""WITH {JOBS_SQL}, s AS (SELECT *, CASE status WHEN 'partial' THEN 'completed_with_warnings' ELSE status END AS st FROM jobs)
SELECT id, st AS status, CASE WHEN total > 0 AND done >= total AND starts_with(st, 'completed') THEN 100 ELSE progress END AS percent,
 CASE WHEN st = 'completed_with_warnings' OR warned THEN 'completed_with_warnings' WHEN st = 'completed' THEN 'completed' END AS quality,
 CASE WHEN coalesce(error, '') <> '' OR status = 'failed' THEN CASE WHEN contains(coalesce(error, ''), 'LaTeX') THEN 'COMPILATION_ERROR' WHEN contains(coalesce(error, ''), 'API') THEN 'MODEL_ERROR' ELSE 'TASK_FAILED' END END AS error_code FROM s""")
def serialized_status(spark, sf_dir):
    """PR2, PR3."""
    return library.serialized(jobs(spark, sf_dir))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, count(*) AS kept, min(event_id) AS oldest FROM r WHERE r <= 40 GROUP BY user_id")
def log_retention(spark, sf_dir):
    """RK6."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    # the limit in the group comes before the gathering, and Spark applies it before the exchange too
    last = read(spark, sf_dir, "events").select("user_id", "event_id", place.alias("place")).where("place <= 40")
    logs = last.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("logs"))
    return logs.withColumn("logs", library.keep_last_logs(F.col("logs"), 40)).select("user_id", F.size("logs").cast("long").alias("kept"), F.array_min("logs").alias("oldest"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_change(spark, sf_dir):
    """SK2, UP3."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return library.upsert(e.where("event_id < 100"), e.where("event_id >= 100"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, min(event_id) AS request_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY user_id, event_type")
def batch_submit(spark, sf_dir):
    """UP7."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("request_id"))
    active = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id")).distinct()
    return library.submit_once(e, active.join(e.select("user_id", "event_type").distinct(), "user_id"), ["user_id", "event_type"]).select("user_id", "event_type", "request_id")


@query("""SELECT page_id, CASE WHEN contains(url, '://api.deepl.com/') THEN 'deepl' ELSE 'custom' END AS service, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages""")
def endpoint_class(spark, sf_dir):
    """STR6."""
    return read(spark, sf_dir, "pages").select("page_id", text.service(F.col("url")).alias("service"), text.url_host(F.col("url")).alias("host"))


@query("SELECT doc_id, regexp_replace(text || ' sk-ab.c-9_x end', 'sk-[A-Za-z0-9._\\-]+', '[hidden]', 'g') AS t FROM documents")
def redaction(spark, sf_dir):
    """STR7."""
    return read(spark, sf_dir, "documents").select("doc_id", text.redact(F.concat("text", F.lit(" sk-ab.c-9_x end"))).alias("t"))


@query("""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents)
SELECT doc_id, len(w) >= 8 AND len(list_intersect(list_distinct(w), ['the','is','are','and','of','with','for','to','we','this','our','these','from','by','that','in'])) >= 2 AS prose FROM w""")
def prose_test(spark, sf_dir):
    """VL2: the prose test."""
    return read(spark, sf_dir, "documents").select("doc_id", text.is_prose(F.col("text")).alias("prose"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 8 AND len(list_intersect(list_distinct(w), ['the','is','are','and','of','with','for','to','we','this','our','these','from','by','that','in'])) >= 2 THEN 'not_translated' END AS error FROM w""")
def language_validation(spark, sf_dir):
    """VL2."""
    return read(spark, sf_dir, "documents").select("doc_id", text.language_error(F.col("text"), F.col("text"), F.lit("zh-hans")).alias("error"))


@query("""SELECT o_orderkey, printf('%04d.%05d', o_orderkey % 10000, o_custkey % 100000) || 'v' || (o_orderkey % 9 + 1) AS paper, printf('%04d.%05d', o_orderkey % 10000, o_custkey % 100000) AS base, CAST(o_orderkey % 9 + 1 AS INTEGER) AS version FROM orders""")
def paper_ids(spark, sf_dir):
    """STR1, STR2, STR3, VL9."""
    o = read(spark, sf_dir, "orders")
    made = F.concat(F.format_string("%04d.%05d", F.col("o_orderkey") % 10000, F.col("o_custkey") % 100000), F.lit("v"), (F.col("o_orderkey") % 9 + 1).cast("string"))
    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://arxiv.org/pdf/"), made, F.lit(".pdf"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" arXiv: "), made)).otherwise(made)
    paper = ids.paper_id(url)
    return o.select("o_orderkey", paper.alias("paper"), ids.base_id(paper).alias("base"), ids.version_number(paper).alias("version"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_first_location(spark, sf_dir):
    """AG1, HS1."""
    s = read(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), F.col("doc_id").alias("file_no"), F.lit(0).alias("start"))
    return segments.first_locations(s).select(F.col("key").alias("digest"), F.col("file_no").alias("doc_id"), "n")


@query("WITH u AS (SELECT DISTINCT sha256(text) AS k, text FROM documents) SELECT count(*) FILTER (unicode(substr(k, 1, 1)) % 3 = 0) AS hits, count(*) FILTER (unicode(substr(k, 1, 1)) % 3 <> 0) AS misses FROM u")
def cache_hit_miss(spark, sf_dir):
    """JN3."""
    u = read(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("key")).distinct()
    cache = u.where(F.ascii(F.substring("key", 1, 1)) % 3 == 0).select(F.lit("c").alias("config_hash"), "key", F.lit("x").alias("masked_translation"))
    hit = segments.cache_join(u, cache, "c")
    return hit.agg(F.count("masked_translation").alias("hits"), F.count_if(F.col("masked_translation").isNull()).alias("misses"))


@query("SELECT doc_id AS file, CASE WHEN length(text) > 40 THEN substr(text, 1, 10) || '<A>' || substr(text, 21, 10) || '<B>' || substr(text, 41) ELSE text END AS text FROM documents")
def writeback(spark, sf_dir):
    """JN4."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    s = d.where(F.length("text") > 40).select("file", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("key")) for a, b, k in ((10, 20, "a"), (30, 40, "b"), (0, 5, "none"))])).alias("s")).select("file", "s.*")
    t = spark.sql("select * from values ('a', '<A>'), ('b', '<B>') as t(key, value)")
    return segments.writeback(d, s, t)


@query("SELECT doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS line FROM documents")
def line_numbers(spark, sf_dir):
    """JN7."""
    return read(spark, sf_dir, "documents").select("doc_id", segments.line_of(F.col("text"), F.length("text")).cast("long").alias("line"))


def _edges(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    e = p.where("k > 0").select(F.lit(1).alias("project"), F.when(F.col("k") % 23 == 0, F.col("k")).otherwise(F.floor((F.col("k") - 1) / 5).cast("long")).alias("src"), F.col("k").alias("dst"), (F.col("k") % 17 == 0).alias("opaque"))
    return p, e


EDGE_SQL = "e AS (SELECT CASE WHEN p_partkey % 23 = 0 THEN p_partkey ELSE (p_partkey - 1) // 5 END AS src, p_partkey AS dst, p_partkey % 17 = 0 AS opaque FROM part WHERE p_partkey > 0)"


@query(f"WITH RECURSIVE {EDGE_SQL}, r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def include_reachability(spark, sf_dir):
    """GR1."""
    _, e = _edges(spark, sf_dir)
    return graph.reachable(e, spark.range(1).select(F.lit(1).alias("project"), F.col("id").alias("node"))).select("node")


@query(f"""WITH RECURSIVE {EDGE_SQL}, r(node, o) AS (SELECT CAST(0 AS BIGINT), false UNION SELECT dst, o OR opaque FROM r JOIN e ON src = node),
g AS (SELECT node, bool_and(o) AS a, bool_or(o) AS b FROM r GROUP BY node)
SELECT p_partkey AS node, CASE WHEN a THEN 'opaque' WHEN b THEN 'mixed' ELSE 'open' END AS role FROM part LEFT JOIN g ON node = p_partkey""")
def include_roles(spark, sf_dir):
    """GR2 from the root alone, as the SQL has it."""
    p, e = _edges(spark, sf_dir)
    root = spark.range(1).select(F.lit(1).alias("project"), F.col("id").alias("node"))
    return graph.rooted_roles(e, root, p.select(F.lit(1).alias("project"), F.col("k").alias("node"))).select("node", "role")


@query(f"""WITH RECURSIVE {EDGE_SQL}, r(node, o) AS (SELECT CAST(0 AS BIGINT), false UNION SELECT dst, o OR opaque FROM r JOIN e ON src = node),
rest AS (SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)),
inside AS (SELECT src, dst FROM e WHERE src IN (SELECT node FROM rest) AND dst IN (SELECT node FROM rest)),
c(s, node) AS (SELECT node, node FROM rest UNION SELECT s, dst FROM c JOIN inside ON src = node),
seeds AS (SELECT node FROM c GROUP BY node HAVING min(s) = node),
q(node, o) AS (SELECT node, false FROM seeds UNION SELECT dst, o OR opaque FROM q JOIN e ON src = node),
g AS (SELECT node, bool_and(o) AS a, bool_or(o) AS b FROM (SELECT * FROM r UNION SELECT * FROM q) GROUP BY node)
SELECT p_partkey AS node, CASE WHEN a THEN 'opaque' WHEN b THEN 'mixed' ELSE 'open' END AS role FROM part LEFT JOIN g ON node = p_partkey""")
def include_roles_all(spark, sf_dir):
    """GR2 with the seeds among nodes that the root doesn't reach."""
    p, e = _edges(spark, sf_dir)
    root = spark.range(1).select(F.lit(1).alias("project"), F.col("id").alias("node"))
    return graph.roles(e, root, p.select(F.lit(1).alias("project"), F.col("k").alias("node"))).select("node", "role")


@query("SELECT user_id AS section, list_sort(list(DISTINCT event_type)) AS missing FROM events WHERE NOT (event_type = 'click' AND user_id IN (SELECT o_custkey FROM orders)) GROUP BY user_id")
def missing_citations(spark, sf_dir):
    """JN14."""
    e = read(spark, sf_dir, "events")
    cited = e.select(F.col("user_id").alias("section"), F.col("event_type").alias("key"))
    entries = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), F.lit("click").alias("key")).distinct()
    return graph.missing_citations(cited, entries)


def _marks(spark, sf_dir):
    """Every event is a landmark of its user's pair on both sides."""
    kind = F.when(F.col("event_type") == "click", "section.").when(F.col("event_type") == "view", "figure.").when(F.col("event_type") == "error", "page.").otherwise("cite.")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), (F.col("event_id") * k % 40).cast("int").alias("page"), (F.col("event_id") * k % 8 / 8.0).alias("fraction")) for side, k in (("original", 1), ("translated", 3))])
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("pair_id"), F.concat(kind, F.col("event_id").cast("string")).alias("name"), F.explode(sides).alias("s")).select("pair_id", "name", "s.*")


@query("""SELECT user_id AS pair_id, (CASE event_type WHEN 'click' THEN 'section.' WHEN 'view' THEN 'figure.' ELSE 'cite.' END) || event_id AS name,
 event_id % 40 + (event_id % 8) / 8.0 AS original, event_id * 3 % 40 + (event_id * 3 % 8) / 8.0 AS translated, CASE event_type WHEN 'click' THEN 12 WHEN 'view' THEN 10 ELSE 2 END AS weight FROM events WHERE event_type <> 'error'""")
def landmark_join(spark, sf_dir):
    """JN1, ST1, RK12."""
    return align.match_landmarks(_marks(spark, sf_dir)).select("pair_id", "name", "original", "translated", "weight")


@query("SELECT user_id AS pair_id, event_id AS page, coalesce(sum(event_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start FROM events")
def height_offsets(spark, sf_dir):
    """RK10."""
    h = read(spark, sf_dir, "events").select(F.col("user_id").alias("pair_id"), F.lit("original").alias("side"), F.col("event_id").alias("page"), (F.col("event_id") % 7 + 1).cast("double").alias("ratio"))
    return align.page_starts(h).select("pair_id", "page", "start")


@query("""WITH h AS (SELECT u.user_id AS p, 'o' AS side, k AS page, 1 + k % 3 * 0.25 AS r FROM (SELECT DISTINCT user_id FROM events) u, range(1, 40) t(k) WHERE k <= 3 + user_id % 5
 UNION ALL SELECT u.user_id, 't', k, 1 + k % 2 * 0.5 FROM (SELECT DISTINCT user_id FROM events) u, range(1, 40) t(k) WHERE k <= 2 + user_id % 7),
e AS (SELECT p, side, page, r, coalesce(sum(r) OVER (PARTITION BY p, side ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM h),
z AS (SELECT p, sum(r) FILTER (side = 'o') AS oz, sum(r) FILTER (side = 't') AS tz, max(page) FILTER (side = 'o') AS op, max(page) FILTER (side = 't') AS tp FROM h GROUP BY p),
l0 AS (SELECT user_id AS p, event_id / 256.0 AS o, CASE WHEN user_id % 4 = 0 THEN (event_id * 7 % 64) / 16.0 ELSE event_id / 256.0 + user_id % 4 * 0.125 END AS t FROM events WHERE event_type = 'click'),
m AS (SELECT l0.p, o, t FROM l0 JOIN z USING (p) WHERE o > 0 AND t > 0 AND o < oz AND t < tz UNION ALL SELECT p, 0.0, 0.0 FROM z UNION ALL SELECT p, oz, tz FROM z),
s AS (SELECT p, o, t, lag(o) OVER w AS po, lag(t) OVER w AS pt FROM m WINDOW w AS (PARTITION BY p ORDER BY o, t)),
g AS (SELECT p, bool_and(coalesce(o > po AND t > pt, true)) AND p IN (SELECT p FROM l0) AS good FROM s GROUP BY p),
q AS (SELECT event_id AS q, user_id AS p, event_id % 11 AS page, event_id % 16 / 16.0 AS f FROM events),
c AS (SELECT q.q, q.p, q.page, f, good, tz, tp, e.at + f * e.r AS v FROM q JOIN z USING (p) JOIN g USING (p) JOIN e ON e.p = q.p AND e.side = 'o' AND e.page = greatest(1, least(op, q.page))),
i AS (SELECT c.q, max_by(STRUCT_PACK(o := o, t := t), o) FILTER (o <= v) AS lo, min_by(STRUCT_PACK(o := o, t := t), o) FILTER (o > v) AS hi FROM c JOIN m ON m.p = c.p WHERE good GROUP BY c.q),
x AS (SELECT c.*, CASE WHEN hi IS NULL THEN lo.t ELSE lo.t + (v - lo.o) / (hi.o - lo.o) * (hi.t - lo.t) END AS y FROM c LEFT JOIN i USING (q))
SELECT x.p AS pair_id, x.q AS query_id, CAST(CASE WHEN good THEN e.page ELSE greatest(1, least(tp, x.page)) END AS INTEGER) AS page, round(CASE WHEN good THEN greatest(0, least(1, (y - e.at) / e.r)) ELSE f END, 6)::DOUBLE AS fraction
FROM x LEFT JOIN e ON good AND e.p = x.p AND e.side = 't' AND e.page = greatest(1, (SELECT max(page) FROM e n WHERE n.p = x.p AND n.side = 't' AND n.at <= y))""")
def asof_interpolation(spark, sf_dir):
    """JN6, AR4, PL3, RK10: positions mapped between landmarks, some pairs of documents having landmarks out of order."""
    e = read(spark, sf_dir, "events")
    u = F.col("user_id")
    users = e.select("user_id").distinct()
    pages = lambda side, most, ratio: users.select(u.alias("pair_id"), F.lit(side).alias("side"), F.explode(F.sequence(F.lit(1), most.cast("int"))).alias("page")).withColumn("ratio", ratio)
    heights = pages("original", 3 + u % 5, 1 + F.col("page") % 3 * 0.25).unionByName(pages("translated", 2 + u % 7, 1 + F.col("page") % 2 * 0.5))
    at = F.col("event_id") / 256.0
    t = F.when(u % 4 == 0, F.col("event_id") * 7 % 64 / 16.0).otherwise(at + u % 4 * 0.125)
    marks = e.where("event_type = 'click'").select(u.alias("pair_id"), at.alias("original"), t.alias("translated"))
    asked = e.select(u.alias("pair_id"), F.col("event_id").alias("query_id"), (F.col("event_id") % 11).cast("int").alias("page"), (F.col("event_id") % 16 / 16.0).alias("fraction"))
    return align.map_positions(asked, marks, heights).select("pair_id", "query_id", "page", F.round("fraction", 6).alias("fraction"))


@query("""WITH RECURSIVE m AS (SELECT user_id AS p, (CASE event_type WHEN 'click' THEN 'section.' WHEN 'view' THEN 'figure.' ELSE 'cite.' END) || event_id AS name,
 event_id % 40 + (event_id % 8) / 8.0 AS x, event_id * 3 % 40 + (event_id * 3 % 8) / 8.0 AS y, CASE event_type WHEN 'click' THEN 12 WHEN 'view' THEN 10 ELSE 2 END AS w FROM events WHERE event_type <> 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY x, w DESC, name) AS n FROM m),
c AS (SELECT p, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, s BIGINT, j BIGINT, b BIGINT)[]) AS l FROM r GROUP BY p
 UNION ALL SELECT c.p, r.n, list_append(l, {'x': r.x, 'y': r.y, 's': r.w + coalesce(-f.s, 0), 'j': r.n, 'b': coalesce(f.j, 0)}) FROM c JOIN r ON r.p = c.p AND r.n = c.n + 1,
  LATERAL (SELECT list_min(list_transform(list_filter(l, lambda e: e.x < r.x - 1e-7 AND e.y < r.y - 1e-7), lambda e: {'s': -e.s, 'j': e.j})) AS f)),
z AS (SELECT p, l FROM c QUALIFY n = max(n) OVER (PARTITION BY p)),
t AS (SELECT p, l, list_min(list_transform(l, lambda e: {'s': -e.s, 'j': e.j})).j AS j FROM z UNION ALL SELECT p, l, l[j].b FROM t WHERE l[j].b > 0)
SELECT r.p AS pair_id, name, CAST(x AS DOUBLE) AS original, CAST(y AS DOUBLE) AS translated, CAST(w AS INTEGER) AS weight, CAST(row_number() OVER (PARTITION BY r.p ORDER BY n) AS INTEGER) AS place FROM t JOIN r ON r.p = t.p AND r.n = t.j""")
def monotone_chain(spark, sf_dir):
    """RK9."""
    return align.chains(align.match_landmarks(_marks(spark, sf_dir)))


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, strlen(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g AS (SELECT source, i, doc_id, 0::BIGINT AS batch, 1 AS cnt, n AS tot FROM r WHERE i = 1
 UNION ALL SELECT r.source, r.i, r.doc_id, CASE WHEN cnt >= 50 OR tot + n > 131072 THEN batch + 1 ELSE batch END, CASE WHEN cnt >= 50 OR tot + n > 131072 THEN 1 ELSE cnt + 1 END, CASE WHEN cnt >= 50 OR tot + n > 131072 THEN n ELSE tot + n END
 FROM g JOIN r ON r.source = g.source AND r.i = g.i + 1)
SELECT source, doc_id AS ord, batch FROM g""")
def greedy_batches(spark, sf_dir):
    """RK14."""
    d = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), "text")
    return align.batches(d, "source")


@query()
def segment_inventory(spark, sf_dir):
    """TX1, SG1, AG1, JN3: segments and distinct keys of each language and source."""
    d = texts(spark, sf_dir)
    key = segments.segment_key(F.col("role"), F.col("source"), F.col("masked"), F.col("protected"))
    found = frames.segment_table(d.select(F.struct("doc_id", "lang", F.col("source").alias("src")).alias("at"), "text"), "at").select("at.*", key.alias("key"), F.length("source").alias("chars"))
    # two levels: the keys of a hot source are spread over all tasks before they are counted
    return found.groupBy("lang", "src", "key").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).groupBy("lang", "src").agg(F.sum("n").alias("segments"), F.count("*").alias("unique_keys"), F.sum("chars").alias("chars"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def writeback_roundtrip(spark, sf_dir):
    """TX1, SG3, SG5, JN4: texts whose segments are masked, restored and written back are as they were."""
    d = texts(spark, sf_dir)
    restored = F.col("r.value")
    found = frames.segment_table(d, "doc_id").withColumn("r", frames.restored("masked", "protected", "masked")).select("doc_id", "start", "end", restored.alias("value"))
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("spans"))
    whole = d.select("doc_id", "text").join(spans, "doc_id", "left")
    return whole.select("doc_id", F.sha2(segments.spliced(F.col("text"), F.col("spans")).cast("binary"), 256).alias("digest"))


@query(r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(length(regexp_replace(regexp_replace(text, '%[^\n]*', '', 'g'), '\s', '', 'g')) AS INTEGER) AS visible,
 CAST(length(regexp_replace(regexp_replace(text, '%[^\n]*', '', 'g'), '\s', '', 'g')) AS INTEGER) AS uncommented FROM documents""")
def visible_text(spark, sf_dir):
    """STR9, STR10: characters of a text outside comments and code; without a backslash, as its SQL takes for granted, only comments are hidden."""
    d = texts(spark, sf_dir).select("doc_id", tokens.visible(F.col("text"), tokens.declared_environments(F.col("text"))).alias("t"), tokens.without_comments(F.col("text")).alias("u"))
    bare = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    return d.select("doc_id", F.length("t").alias("chars"), bare(F.col("t")).alias("visible"), bare(F.col("u")).alias("uncommented"))


@query("SELECT event_id, CASE WHEN json_type(j, '$.type') = 'VARCHAR' AND json_type(j, '$.k') = 'VARCHAR' THEN json_extract_string(j, '$.k') END AS k FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN '{\"type\": \"click\", \"k\": \"a\"}' WHEN event_type = 'error' THEN '{\"type\": \"error\", \"k\": 5}' ELSE props END AS j FROM events)")
def marker_json(spark, sf_dir):
    """JS1: markers whose fields are strings; numbers are no strings."""
    note = F.when(F.col("event_type") == "click", '{"type": "click", "k": "a"}').when(F.col("event_type") == "error", '{"type": "error", "k": 5}').otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", records.marker_json(note, ("type", "k"))["k"].alias("k"))


CHILD_SQL = "c AS (SELECT o_custkey AS parent_id, o_orderpriority AS paper_id, CASE o_orderstatus WHEN 'F' THEN 'translation' ELSE 'original' END AS kind, o_orderkey % 5 = 0 AS warned FROM orders)"


@query(f"""WITH {CHILD_SQL}, o AS (SELECT DISTINCT parent_id, paper_id FROM c WHERE kind = 'original'), t AS (SELECT DISTINCT parent_id, paper_id FROM c WHERE kind = 'translation' AND NOT warned),
m AS (SELECT o.parent_id, count(*) AS n FROM o LEFT JOIN t ON o.parent_id = t.parent_id AND o.paper_id = t.paper_id WHERE t.paper_id IS NULL GROUP BY 1)
SELECT c.parent_id, CASE WHEN NOT bool_or(kind = 'translation') THEN 'untranslated' WHEN coalesce(any_value(m.n), 0) = 0 THEN 'translated' ELSE 'review' END AS status, coalesce(any_value(m.n), 0) AS uncovered FROM c LEFT JOIN m ON m.parent_id = c.parent_id GROUP BY c.parent_id""")
def parent_status(spark, sf_dir):
    """AG10."""
    o = read(spark, sf_dir, "orders")
    c = o.select(F.col("o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("paper_id"), F.when(F.col("o_orderstatus") == "F", "translation").otherwise("original").alias("kind"), (F.col("o_orderkey") % 5 == 0).alias("warned"))
    return records.parent_status(c).select("parent_id", "status", F.size("uncovered").cast("long").alias("uncovered"))


@query("""WITH e AS (SELECT o_custkey AS k, printf('%04d.00001', o_custkey % 1000 + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS base, o_orderkey % 2 + 1 AS v FROM orders),
g AS (SELECT k, min(base) AS a, max(base) AS b, min(base || 'v' || v) AS c, max(base || 'v' || v) AS d FROM e GROUP BY k)
SELECT k, CASE WHEN a = b AND c = d THEN a END AS base, CASE WHEN a = b AND c = d THEN c END AS version, NOT (a = b AND c = d) AS conflict FROM g""")
def evidence_summary(spark, sf_dir):
    """AG11, RK7."""
    base = F.format_string("%04d.00001", F.col("o_custkey") % 1000 + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.concat(base, F.lit("v"), (F.col("o_orderkey") % 2 + 1).cast("string")).alias("paper"))
    return records.evidence(rows, "k", "paper")


@query("SELECT event_id, sha256(CAST(to_json({event_id: event_id, event_type: event_type, user_id: user_id}) AS VARCHAR)) AS fingerprint FROM events")
def request_fingerprint(spark, sf_dir):
    """HS2."""
    return read(spark, sf_dir, "events").select("event_id", records.request_fingerprint("user_id", "event_type", "event_id").alias("fingerprint"))


@query("""SELECT page_id, CASE WHEN NOT coalesce(regexp_matches(lower(url), '[.](tex|zip|tar|tgz|gz)$'), false) THEN 'unsupported_type' WHEN NOT coalesce(length(html) > 0, false) THEN 'empty' WHEN length(html) > 80000000 THEN 'too_large' END AS upload,
 CASE WHEN NOT coalesce(regexp_matches(url, '^https?://[^/?#\\s]+'), false) THEN 'invalid_url' WHEN regexp_matches(url, '^https?://[^/?#]*@') THEN 'credentials_in_url' WHEN regexp_matches(url, '[?#]') THEN 'query_in_url' END AS address FROM pages""")
def input_rules(spark, sf_dir):
    """VL7, VL8."""
    return read(spark, sf_dir, "pages").select("page_id", records.upload_error(F.col("url"), F.length("html")).alias("upload"), records.url_error(F.col("url")).alias("address"))


@query("SELECT event_type AS name, count(*) AS n, CASE WHEN min(user_id) = max(user_id) THEN min(user_id) END AS value FROM events GROUP BY 1")
def single_definitions(spark, sf_dir):
    """AG5, AG7."""
    return graph.single_definitions(read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("value")))


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT o_custkey AS k, min(o_orderkey) % 25 AS v FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def changed_keys(spark, sf_dir):
    """ST4."""
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    b = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.min("o_orderkey") % 25).alias("v"))
    return graph.changed_keys(a, b, "k", "v")


HEAD_ID = "printf('%04d.%05d', page_id % 10000, page_id % 100000)"


@query(f"""WITH p AS (SELECT page_id, {HEAD_ID} AS i FROM pages)
SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 'Paper ' || page_id || ' & its title' END AS title, CASE WHEN page_id % 3 = 0 THEN [1, 2, 3] ELSE CAST([] AS INTEGER[]) END AS versions FROM p""")
def page_heads(spark, sf_dir):
    """HT1, HT2: titles and versions that page heads state; a head for each page, with two titles, another id or none in some."""
    i, n = F.format_string("%04d.%05d", F.col("page_id") % 10000, F.col("page_id") % 100000), F.col("page_id") % 5
    title = F.concat(F.lit('<meta name="citation_title" content="Paper  '), F.col("page_id").cast("string"), F.lit(' &amp; its\n title">'))
    named = F.concat(F.lit('<meta name="Citation_arXiv_id" content="'), F.when(n == 3, F.concat(i, F.lit("7"))).otherwise(F.concat(i, F.lit("v2"))), F.lit('">'))
    head = F.concat(F.when(n == 4, "").otherwise(title), F.when(n == 2, title).otherwise(F.lit("")), named)
    history = F.when(F.col("page_id") % 3 == 0, '<div class="x submission-history">[v3] <div>[v1]</div> [v2]</div> [v9]').otherwise("[v4]")
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), history, F.coalesce("html", F.lit("")), F.lit("</body></html>"))

    @F.pandas_udf("struct<title: string, versions: array<int>>")
    def read_head(html, identifier):
        import pandas as pd

        return pd.DataFrame([(response.page_title(h, x), response.history_versions(h)) for h, x in zip(html, identifier)], columns=["title", "versions"])

    return read(spark, sf_dir, "pages").select("page_id", read_head(html, i).alias("h")).select("page_id", "h.*")


PARAGRAPH = 50
CODE = "\\begin{verbatim}\na % b\n\\end{verbatim}\n"


def _tex(d: DataFrame) -> DataFrame:
    """documents (doc_id, tex): the words of each text in paragraphs of PARAGRAPH words, with a bold word, a formula, a citation, a share and a comment each, and code at the end."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1))
    doc = F.col("doc_id").cast("string")
    lit = lambda x: F.lit(x)

    def paragraph(i: Column) -> Column:
        w = F.slice("w", i * PARAGRAPH + 1, PARAGRAPH)
        first, rest = F.element_at(w, 1), F.array_join(F.slice(w, 2, PARAGRAPH), " ")
        return F.concat(lit("\\textbf{"), first, lit("} says "), rest, lit(" $x_"), i.cast("string"), lit("$ in~\\cite{k"), doc, lit("} by 5\\% more% note "), first, lit("\n\n"))

    parts = F.transform(F.sequence(F.lit(0), (F.ceil(F.size("w") / PARAGRAPH) - 1).cast("int")), paragraph)
    return d.select("doc_id", words.alias("w")).select("doc_id", F.concat(F.when(F.size("w") > 0, F.array_join(parts, "")).otherwise(lit("")), lit(CODE)).alias("tex"))


TEX_SQL = f"""w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS w FROM documents),
p AS (SELECT doc_id, i, w[i * {PARAGRAPH} + 1] AS a, array_to_string(w[i * {PARAGRAPH} + 2 : i * {PARAGRAPH} + {PARAGRAPH}], ' ') AS b FROM w, LATERAL (SELECT unnest(range(0, (len(w) + {PARAGRAPH - 1}) // {PARAGRAPH})) AS i)),
t AS (SELECT doc_id, i, a, b, '\\textbf{{' || a || '}} says ' || b || ' $x_' || i || '$ in~\\cite{{k' || doc_id || '}} by 5\\% more' AS head, '% note ' || a AS note FROM p)"""
CODE_SQL = "'\\begin{verbatim}' || chr(10) || 'a % b' || chr(10) || '\\end{verbatim}' || chr(10)"


@query(f"""WITH {TEX_SQL} SELECT doc_id, CAST(i AS INTEGER) AS ord, '⟪P0000⟫⟪P0001⟫' || a || '⟪P0002⟫ says ' || b || ' ⟪P0003⟫ in⟪P0004⟫ by ⟪P0005⟫ more⟪P0006⟫' AS masked,
 ['\\textbf', '{{', '}}', '$x_' || i || '$', '~\\cite{{k' || doc_id || '}}', '5\\%', '% note ' || a || chr(10)] AS protected FROM t""")
def tex_segments(spark, sf_dir):
    """TX1, TX2, TX3, STR18: the segments of TeX around each document's words, as the contract has them."""
    return frames.segment_table(_tex(texts(spark, sf_dir)), "doc_id", "tex").select("doc_id", "ord", "masked", "protected")


@query(f"""WITH {TEX_SQL}, x AS (SELECT doc_id, string_agg(head || note || chr(10) || chr(10), '' ORDER BY i) AS x FROM t GROUP BY doc_id)
SELECT documents.doc_id, sha256(coalesce(x, '') || {CODE_SQL}) AS digest FROM documents LEFT JOIN x ON x.doc_id = documents.doc_id""")
def tex_roundtrip(spark, sf_dir):
    """SG2, SG3, SG5, JN4: TeX whose segments are masked, restored and written back is as it was."""
    d = _tex(texts(spark, sf_dir))
    found = frames.segment_table(d, "doc_id", "tex").withColumn("r", frames.restored("masked", "protected", "masked")).select("doc_id", "start", "end", F.col("r.value").alias("value"))
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("spans"))
    whole = d.join(spans, "doc_id", "left")
    return whole.select("doc_id", F.sha2(segments.spliced(F.col("tex"), F.col("spans")).cast("binary"), 256).alias("digest"))


@query(f"""WITH {TEX_SQL}, x AS (SELECT doc_id, string_agg(head || repeat(' ', length(note)) || chr(10) || chr(10), '' ORDER BY i) AS x, count(*) AS n, sum(length('$x_' || i || '$')) AS c FROM t GROUP BY doc_id)
SELECT documents.doc_id, sha256(coalesce(x, '') || repeat(' ', 16) || chr(10) || repeat(' ', 5) || chr(10) || repeat(' ', 14) || chr(10)) AS digest, coalesce(n, 0) AS formulas, CAST(coalesce(c, 0) AS BIGINT) AS chars FROM documents LEFT JOIN x ON x.doc_id = documents.doc_id""")
def tex_visible(spark, sf_dir):
    """STR9, STR10, STR11, TX4: TeX with comments and code as blanks, and the formulas outside them."""
    d = _tex(texts(spark, sf_dir)).withColumn("seen", tokens.visible(F.col("tex"), tokens.declared_environments(F.col("tex")))).withColumn("m", tokens.math_ranges(F.col("seen")))
    chars = F.aggregate("m", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return d.select("doc_id", F.sha2(F.col("seen").cast("binary"), 256).alias("digest"), F.size("m").cast("long").alias("formulas"), chars.alias("chars"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS w FROM documents),
i AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM w),
o AS (SELECT doc_id, n, i, sum(length(w) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 2 AS start, sum(length(w) + 2) OVER (PARTITION BY doc_id) + n - i AS stop FROM i)
SELECT doc_id, count(*) AS groups, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS ends, CAST(max(i) AS INTEGER) AS depth, CAST(coalesce(sum(lag_start), 0) AS BIGINT) AS parents FROM
  (SELECT *, lag(start) OVER (PARTITION BY doc_id ORDER BY i) AS lag_start FROM o) GROUP BY doc_id""")
def tex_groups(spark, sf_dir):
    """TX2: the groups of texts whose every word opens a group inside that of the word before."""
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1))
    d = texts(spark, sf_dir).select("doc_id", w.alias("w")).where(F.size("w") > 0)
    nested = F.concat(F.array_join(F.transform("w", lambda x: F.concat(F.lit("{"), x, F.lit(" "))), ""), F.repeat(F.lit("}"), F.size("w")))
    found = tokens.text_groups(d.select("doc_id", nested.alias("text")), "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("groups"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.max("depth").alias("depth"), F.coalesce(F.sum("parent"), F.lit(0).cast("long")).alias("parents"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents),
d AS (SELECT doc_id, doc_id % 2 = 0 AS listed, array_to_string(w, ' ') AS words FROM w),
p AS (SELECT doc_id, listed, words, '\RecustomVerbatimEnvironment{e' || doc_id || '}{Verbatim}{}' AS said, '\begin{e' || doc_id || '}' || words || ' $n$ % a $m$' || chr(10) || '\end{e' || doc_id || '}' AS body FROM d)
SELECT doc_id, sha256(CASE WHEN listed THEN said || chr(10) || repeat(' ', length('\begin{e' || doc_id || '}' || words || ' $n$ % a $m$')) || chr(10) || repeat(' ', length('\end{e' || doc_id || '}'))
  ELSE repeat(' ', 16) || chr(10) || repeat(' ', length(said)) || chr(10) || repeat(' ', 14) || chr(10) || '\begin{e' || doc_id || '}' || words || ' $n$ ' || repeat(' ', 7) || chr(10) || '\end{e' || doc_id || '}' END) AS digest,
  CASE WHEN listed THEN 0 ELSE 1 END AS formulas FROM p""")
def tex_declared(spark, sf_dir):
    """STR11: literal environments that texts declare, and those whose declaration is only printed in a listing."""
    words = F.array_join(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1)), " ")
    name = F.concat(F.lit("e"), F.col("doc_id").cast("string"))
    said = F.concat(F.lit("\\RecustomVerbatimEnvironment{"), name, F.lit("}{Verbatim}{}"))
    body = F.concat(F.lit("\\begin{"), name, F.lit("}"), words, F.lit(" $n$ % a $m$\n\\end{"), name, F.lit("}"))
    printed = F.concat(F.lit("\\begin{verbatim}\n"), said, F.lit("\n\\end{verbatim}\n"), body)
    d = texts(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(said, F.lit("\n"), body)).otherwise(printed).alias("tex"))
    seen = d.select("doc_id", tokens.visible(F.col("tex"), tokens.declared_environments(F.col("tex"))).alias("seen"))
    return seen.select("doc_id", F.sha2(F.col("seen").cast("binary"), 256).alias("digest"), F.size(tokens.math_ranges(F.col("seen"))).alias("formulas"))
