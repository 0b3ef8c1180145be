"""Queries for small records and texts: orders, events and customers carry forms of input chosen by their keys."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from texloom.functions import ids, records, text
from texloom.operators import align, graph, library, segments
from texloom.queries import query, read, texts
from texloom.sources import archives
from texloom.tex import frames


def form(values: list[str], key: str) -> Column:
    """One of values for each row, by its key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def form_sql(values: list[str], key: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{key} % {len(values)} + 1]"


PATHS = ["a/b.tex", "/abs.tex", "a\\..\\b.tex", "c:/x.tex", "a/CON.tex", "a/com1 .b", "x/na<me.tex", "tail. /q", "./dot./q", "../up", "lpt1", "auxiliary.tex", "..a/b"]


@query(f"""WITH n AS (SELECT o_orderkey, replace({form_sql(PATHS, "o_orderkey")}, chr(92), '/') AS n FROM orders), p AS (SELECT *, list_filter(string_split(n, '/'), lambda x: x NOT IN ('', '.')) AS p FROM n)
SELECT o_orderkey, NOT (n[1] = '/' OR list_contains(p, '..') OR contains(n, ':')) AS safe, len(list_filter(p, lambda x: regexp_matches(x, '[<>:"|?*]') OR right(x, 1) IN (' ', '.')
 OR upper(rtrim(split_part(x, '.', 1))) IN ('CON', 'PRN', 'AUX', 'NUL') OR regexp_full_match(upper(rtrim(split_part(x, '.', 1))), '(COM|LPT)[1-9]'))) = 0 AS windows FROM p""")
def path_rules(spark, sf_dir):
    """SC4, SC5."""
    name = form(PATHS, "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.safe_path(name).alias("safe"), text.windows_path(name).alias("windows"))


STEMS = ["..a paper", "", "--", "a/b:c*d", "2401.00001v2", "x" * 80, "end. -"]


@query(f"""WITH s AS (SELECT o_orderkey, left(trim(regexp_replace({form_sql(STEMS, "o_orderkey")}, '[^A-Za-z0-9_.-]+', '-', 'g'), '.-'), 72) AS s FROM orders) SELECT o_orderkey, CASE WHEN s = '' THEN 'paper' ELSE s END AS stem FROM s""")
def file_stems(spark, sf_dir):
    """STR22."""
    return read(spark, sf_dir, "orders").select("o_orderkey", text.file_stem(form(STEMS, "o_orderkey")).alias("stem"))


DELAYS = ["5", "-3", "later", "inf", "nan", "1.5", "", "4d"]


@query(f"""WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN CASE {form_sql(DELAYS, "o_orderkey // 2")} WHEN '5' THEN 5.0 WHEN '-3' THEN -3.0 WHEN '1.5' THEN 1.5 END
 ELSE CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1998-06-01') AS DOUBLE) END AS w FROM orders) SELECT o_orderkey, CAST(CASE WHEN w > 3 THEN w ELSE 3 END AS DOUBLE) AS delay FROM h""")
def retry_delays(spark, sf_dir):
    """DT1: headers of seconds and of dates."""
    o = read(spark, sf_dir, "orders").withColumn("_half", F.floor(F.col("o_orderkey") / 2))
    dated = F.date_format(F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone()), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("o_orderkey") % 2 == 1, form(DELAYS, "_half")).otherwise(dated)
    return o.select("o_orderkey", text.retry_delay(header, F.timestamp_seconds(F.lit(896659200)), F.lit(3.0)).alias("delay"))


PAGES = [" 7 ", "x", "", "0", "-3", "2.9", "1e2", "99999", "+4"]


@query(f"""WITH n AS (SELECT event_id, value, TRY_CAST(trim({form_sql(PAGES, "event_id")}) AS DOUBLE) AS n FROM events)
SELECT event_id, CAST(CASE WHEN n IS NULL THEN 5 ELSE greatest(1, least(trunc(n), 40)) END AS INTEGER) AS page, round(greatest(0.5, least(2.5, 1.25 * exp(-(value * 100 - 500) / 1000))), 6) AS zoom FROM n""")
def reader_inputs(spark, sf_dir):
    """STR25, AR1."""
    page = records.page_number(form(PAGES, "event_id"), F.lit(5), F.lit(40))
    return read(spark, sf_dir, "events").select("event_id", page.alias("page"), F.round(records.zoom(F.lit(1.25), F.col("value") * 100 - 500), 6).alias("zoom"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN '1 page of {count} in ' ELSE (o_orderkey % 3) || ' pages of {count} in ' END || o_orderpriority || ' for {who}' AS message,
CAST(CASE WHEN o_orderkey % 13 > 0 THEN 25 + (60 * (o_orderkey % 11)) // (o_orderkey % 13) ELSE 25 END AS INTEGER) AS progress FROM orders""")
def job_messages(spark, sf_dir):
    """STR23, STR26: values that look like names stay as they are."""
    k = F.col("o_orderkey")
    values = F.create_map(F.lit("count"), (k % 3).cast("string"), F.lit("of"), F.lit("{count}"), F.lit("in"), F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", records.message(F.lit("{count} pages of {of} in {in} for {who}"), values).alias("message"), text.progress(k % 11, k % 13).alias("progress"))


NAMES, VALUES = ["X-B", "X-a", "Host", "a b", "TE", "Accept", "n" * 129], ["v", " pad ", "é", "a\tb", "z" * 4097]


@query(f"""WITH h AS (SELECT o_orderkey, {form_sql(NAMES, "o_orderkey")} AS n, {form_sql(VALUES, "o_orderkey")} AS v FROM orders),
e AS (SELECT *, CASE WHEN length(n) > 128 OR contains(n, ' ') THEN 'invalid_name' WHEN n IN ('Host', 'TE') THEN 'reserved_name' WHEN length(v) > 4096 THEN 'long_value' WHEN v IN ('é', 'a' || chr(9) || 'b') THEN 'invalid_value' WHEN n = 'X-a' THEN 'repeated_name' END AS error FROM h)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN list_sort([lower(n), 'x-a']) ELSE [] END AS names, CASE WHEN error IS NULL THEN trim(v) END AS value FROM e""")
def header_rules(spark, sf_dir):
    """JS3, JS4."""
    headers = F.create_map(form(NAMES, "o_orderkey"), form(VALUES, "o_orderkey"), F.lit("X-A"), F.lit("ok"))
    cleaned = F.try_element_at(records.clean_headers(headers), F.lower(form(NAMES, "o_orderkey")))
    return read(spark, sf_dir, "orders").select("o_orderkey", records.headers_error(headers).alias("error"), records.header_names(headers).alias("names"), cleaned.alias("value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_orderpriority || o_orderkey END AS value FROM orders""")
def decoded_values(spark, sf_dir):
    """JS5: encoded values, whole, with a blank and without their last character."""
    code = F.base64(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).cast("binary"))
    broken = F.when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit(" "), code)).when(F.col("o_orderkey") % 4 == 3, F.substr(code, F.lit(1), F.length(code) - 1)).otherwise(code)
    return read(spark, sf_dir, "orders").select("o_orderkey", records.strict_base64(broken).cast("string").alias("value"))


@query("""SELECT o_orderkey, '{"provider":"' || o_orderpriority || '","task_id":"' || o_orderkey || '"}' AS note FROM orders""")
def written_markers(spark, sf_dir):
    """JS2."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").cast("string").alias("task_id"))
    return o.select("o_orderkey", records.marker_note("provider", "task_id").alias("note"))


@query("""WITH r AS (SELECT event_id, event_id % 130 - 10 AS x, event_id % 70 - 20 AS y, event_id % 40 AS w, event_id % 90 AS h FROM events),
n AS (SELECT event_id, greatest(0, least(1, x / 100)) AS l, greatest(0, least(1, y / 50)) AS t, greatest(0, least(1, (x + w) / 100)) AS r, greatest(0, least(1, (y + h) / 50)) AS b FROM r)
SELECT event_id, CASE WHEN r > l AND b > t THEN l END AS x, CASE WHEN r > l AND b > t THEN t END AS y, CASE WHEN r > l AND b > t THEN r - l END AS width, CASE WHEN r > l AND b > t THEN b - t END AS height FROM n""")
def page_rects(spark, sf_dir):
    """AR1, AR3."""
    n = lambda m, less=0: (F.col("event_id") % m - less).cast("double")
    rect = records.normalized_rect(n(130, 10), n(70, 20), n(40), n(90), F.lit(100.0), F.lit(50.0))
    return read(spark, sf_dir, "events").select("event_id", rect.alias("r")).select("event_id", *(F.col(f"r.{c}").alias(c) for c in ("x", "y", "width", "height")))


@query("""WITH m AS (SELECT event_id, event_id % 5 AS a, event_id % 7 AS b, event_id % 3 AS c, event_id % 11 AS d, event_id % 13 AS e, event_id % 17 AS f FROM events)
SELECT event_id, [CAST(2 * a - b AS DOUBLE), CAST(a + 3 * b AS DOUBLE), CAST(2 * c - d AS DOUBLE), CAST(c + 3 * d AS DOUBLE), CAST(2 * e - f + 4 AS DOUBLE), CAST(e + 3 * f + 5 AS DOUBLE)] AS matrix FROM m""")
def matrix_products(spark, sf_dir):
    """AR5: matrices of rows times (2, 1, -1, 3, 4, 5)."""
    first = F.array(*[(F.col("event_id") % m).cast("double") for m in (5, 7, 3, 11, 13, 17)])
    return read(spark, sf_dir, "events").select("event_id", records.matrix_product(first, F.expr("array(2d, 1d, -1d, 3d, 4d, 5d)")).alias("matrix"))


@query("""WITH g AS (SELECT event_id, event_id % 5 * 90 AS turn, event_id % 700 AS x, event_id % 900 AS y FROM events)
SELECT event_id, CASE WHEN turn IN (90, 270) THEN 600.0::DOUBLE / 800 ELSE 800.0::DOUBLE / 600 END AS ratio,
greatest(0, least(1, CASE turn WHEN 90 THEN (x - 10)::DOUBLE / 600 WHEN 180 THEN (y - 20)::DOUBLE / 800 WHEN 270 THEN 1 - (x - 10)::DOUBLE / 600 ELSE (820 - y)::DOUBLE / 800 END)) AS fraction FROM g""")
def page_geometry(spark, sf_dir):
    """AR2: pages of 600 by 800 points, turned by quarters."""
    turn, x, y = F.col("event_id") % 5 * 90, (F.col("event_id") % 700).cast("double"), (F.col("event_id") % 900).cast("double")
    box = [F.lit(v) for v in (10.0, 20.0, 610.0, 820.0)]
    return read(spark, sf_dir, "events").select("event_id", align.page_ratio(F.lit(600.0), F.lit(800.0), turn).alias("ratio"), align.page_fraction(*box, turn, x, y).alias("fraction"))


@query("""SELECT o_orderkey, o_orderkey % 4 <> 0 AND o_orderkey % 7 IN (0, 1, 2, 3) AS placeholder FROM orders""")
def placeholder_titles(spark, sf_dir):
    """FP4."""
    k, paper = F.col("o_orderkey"), F.format_string("%04d.00001v2", F.col("o_custkey") % 1000)
    name = F.when(k % 7 == 0, "").when(k % 7 == 1, None).when(k % 7 == 2, F.concat(F.lit("ArXiv "), F.upper(paper))).when(k % 7 == 3, F.concat(F.lit("arXiv "), ids.base_id(paper))).when(k % 7 == 4, paper).otherwise(F.concat(F.lit("On arXiv "), paper))
    return read(spark, sf_dir, "orders").select("o_orderkey", ids.placeholder_title(F.when(k % 4 == 0, "upload").otherwise("arxiv"), name, paper).alias("placeholder"))


VERSIONS = ["1.2.3", "v1.10.0", "1.2", "01.2.3", "2.0.0", "0.9.9", "v1.2.3", "x"]


@query(f"""WITH v AS (SELECT o_orderkey, {form_sql(VERSIONS, "o_orderkey")} AS a, {form_sql(VERSIONS, "o_custkey")} AS b FROM orders),
p AS (SELECT *, ['0.9.9', '1.2.3', '1.10.0', '2.0.0'] AS known FROM v) SELECT o_orderkey, coalesce(list_position(known, ltrim(a, 'v')) > list_position(known, ltrim(b, 'v')) AND list_contains(known, ltrim(b, 'v')), false) AS newer FROM p""")
def version_updates(spark, sf_dir):
    """RK17."""
    return read(spark, sf_dir, "orders").select("o_orderkey", ids.version_newer(form(VERSIONS, "o_orderkey"), form(VERSIONS, "o_custkey")).alias("newer"))


STAMPS = [" [cs.CL] 1 Jan 2024", "", " [math.CO] arXiv:%s.00001v9 [cs.CL]", " arXiv:%s.00001v9"]


@query("""WITH k AS (SELECT o_orderkey, printf('%04d', o_custkey % 1000) AS p, o_orderkey % 3 + 1 AS v, o_orderkey % 4 AS f, o_orderkey % 5 = 0 AS other FROM orders)
SELECT o_orderkey, CASE WHEN f = 0 AND NOT other OR f IN (1, 3) AND NOT other AND f <> 3 THEN p || '.00001v' || v END AS id,
CASE WHEN f = 2 THEN 'version_ambiguous' WHEN f = 3 AND NOT other THEN 'version_ambiguous' WHEN f = 0 AND other THEN 'id_conflict' END AS error FROM k""")
def page_stamps(spark, sf_dir):
    """STR5, FP12: strong stamps, weak ones, several versions, and another paper's."""
    k, p = F.col("o_orderkey"), F.format_string("%04d", F.col("o_custkey") % 1000)
    page = F.concat(F.lit("ArXiv : "), p, F.lit(" . 00001 v"), (k % 3 + 1).cast("string"), F.replace(form(STAMPS, "o_orderkey"), F.lit("%s"), p))
    base = F.when(k % 5 == 0, "9999.00001").otherwise(F.concat(p, F.lit(".00001")))
    return read(spark, sf_dir, "orders").select("o_orderkey", records.page_stamp(page, base).alias("s")).select("o_orderkey", "s.id", "s.error")


@query("""WITH k AS (SELECT o_orderkey, printf('%04d.00001', o_custkey % 1000) AS p, o_orderkey % 3 AS f FROM orders)
SELECT o_orderkey, CASE f WHEN 0 THEN [p, p || 'v2', p || 'v3'] WHEN 1 THEN [p || 'v2', p, p || 'v3'] ELSE [p, 'cs.CL/0101001v1'] END AS ids FROM k""")
def record_references(spark, sf_dir):
    """STR3, STR4, FP13: ids of address, title and extra lines; version lines count with one base."""
    k, p = F.col("o_orderkey"), F.format_string("%04d.00001", F.col("o_custkey") % 1000)
    url = F.concat(F.lit("https://arxiv.org/abs/"), p, F.when(k % 3 == 1, "v2").otherwise(""))
    extra = F.lit("note\nVersion: 2\nversion : v3 \nversion: 0\nx2401.00001 2401.00001_b")
    fields = F.array(url, F.lit(None).cast("string"), F.concat(F.lit("see "), p, F.when(k % 3 == 2, ", cs.CL/0101001v1").otherwise(".")), extra)
    return read(spark, sf_dir, "orders").select("o_orderkey", records.record_ids(fields, extra).alias("ids"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'version_changed' WHEN o_orderkey % 12 NOT BETWEEN 1 AND 10 THEN 'no_such_page'
 WHEN o_orderkey % 301 = 0 OR (o_orderkey % 90 + o_orderkey % 40) > 100 OR o_orderkey % 40 = 0 THEN 'out_of_bounds' END AS error FROM orders""")
def annotation_rules(spark, sf_dir):
    """VL6."""
    k = F.col("o_orderkey")
    rect = F.struct((k % 90 / 100).alias("x"), F.lit(0.5).alias("y"), (k % 40 / 100).alias("width"), F.lit(0.5).alias("height"))
    rects = F.array_repeat(rect, F.when(k % 301 == 0, 301).otherwise(2))
    error = records.annotation_error(k % 12, F.lit(10), F.when(k % 5 == 0, "old").otherwise("new"), F.lit("new"), rects)
    return read(spark, sf_dir, "orders").select("o_orderkey", error.alias("error"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 2 = 1 AND (o_orderpriority = '1-URGENT' OR o_orderkey % 10 = 3)""")
def annotations_shown(spark, sf_dir):
    """FP2."""
    k = F.col("o_orderkey")
    comment = F.when(k % 10 == 3, "read with URGENCY").otherwise(F.lit(None).cast("string"))
    a = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 1, "original").otherwise("translated").alias("document"), (k % 6 == 0).alias("deleted"), F.col("o_orderpriority").alias("quote"), comment.alias("comment"))
    return library.annotation_filter(a, "original", "Urgen").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['kept'] ELSE [] END AS warnings, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 5 = 0) THEN 0 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n_logs FROM orders""")
def moved_notices(spark, sf_dir):
    """PR5: notices in either field of warnings, some of them in the logs already."""
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    kept = F.when(k % 3 == 0, F.array(F.lit("kept"))).otherwise(none)
    log = F.array(F.struct(F.lit(1.0).alias("time"), F.lit("notice").alias("message")))
    jobs = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, F.concat(kept, F.array(F.lit("notice")))).otherwise(kept).alias("warnings"), F.when(k % 5 == 0, F.array(F.lit("notice"))).otherwise(none).alias("original_warnings"),
        F.when(k % 7 == 0, log).otherwise(F.slice(log, 1, 0)).alias("logs"), F.lit(2.0).alias("updated_at"),
    )
    return library.move_notice(jobs, "notice").select("o_orderkey", "warnings", F.size("logs").alias("n_logs"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def imports_due(spark, sf_dir):
    """UP5: artifacts, each twice, without a marker."""
    incoming = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return library.insert_new(read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")), incoming.unionByName(incoming), "id")


STATES = "CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'cancel' WHEN 'error' THEN 'fail' ELSE 'finish' END"


@query(f"""WITH e AS (SELECT user_id, event_id, {STATES} AS e FROM events), s AS (SELECT user_id, max(event_id) FILTER (e = 'start') AS began FROM e GROUP BY 1),
t AS (SELECT s.user_id, s.began, arg_min(e.e, e.event_id) AS e FROM s LEFT JOIN e ON e.user_id = s.user_id AND e.event_id > s.began GROUP BY 1, 2)
SELECT user_id AS job_id, CASE WHEN began IS NULL THEN 'interrupted' ELSE CASE e WHEN 'cancel' THEN 'cancelled' WHEN 'fail' THEN 'failed' WHEN 'finish' THEN 'completed' ELSE 'queued' END END AS status FROM t""")
def job_states(spark, sf_dir):
    """UP6: what follows the last start decides."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.lit(0).alias("at"), "event_id", F.expr(STATES).alias("event"))
    return library.fold_states(e)


@query("SELECT o_custkey AS job_id, CAST(sum(o_orderkey % 900) AS BIGINT) AS tokens, CAST(sum(o_orderkey % 7000) AS BIGINT) AS characters, bool_or(o_orderkey % 11 = 0) AS characters_estimated FROM orders GROUP BY 1")
def project_usage(spark, sf_dir):
    """AG8."""
    k = F.col("o_orderkey")
    return segments.project_usage(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), (k % 900).alias("tokens"), (k % 7000).alias("characters"), (k % 11 == 0).alias("estimated")))


@query("""SELECT source AS project, sha256('[' || string_agg('{"path":"' || printf('%09d', doc_id) || '","size":' || strlen(text) || ',"digest":"' || sha256(text) || '"}', ',' ORDER BY doc_id) || ']') AS fingerprint FROM documents GROUP BY 1""")
def project_fingerprints(spark, sf_dir):
    """AG9: every document is a file of its source's project."""
    return segments.fingerprint(read(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.format_string("%09d", "doc_id").alias("path"), F.col("text").alias("content")))


@query("""SELECT event_id, event_id % 2 = 0 AS same FROM events""")
def marker_multisets(spark, sf_dir):
    """AG13: markers in another order, and with one of them twice."""
    second = F.when(F.col("event_id") % 2 == 0, "⟪P00012⟫ b ⟪P0000⟫ a ⟪P0000⟫").otherwise("⟪P00012⟫⟪P0000⟫⟪P00012⟫")
    return read(spark, sf_dir, "events").select("event_id", segments.same_markers(F.lit("⟪P0000⟫ a ⟪P0000⟫⟪P00012⟫"), second).alias("same"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace('Bearer ab.c= sk-x1 ' || text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents), r AS (SELECT doc_id, regexp_replace(regexp_replace(t, 'sk-[A-Za-z0-9._-]+', '[hidden]', 'g'), '(?i)\\bBearer +[A-Za-z0-9._~+/=-]+', 'Bearer [hidden]', 'g') AS r FROM t)
SELECT doc_id, CASE WHEN length(r) > 500 THEN left(r, 500) || '…' ELSE r END AS detail FROM r""".replace("\\\\", "\\"))
def error_details(spark, sf_dir):
    """STR8."""
    return read(spark, sf_dir, "documents").select("doc_id", text.error_detail(F.concat(F.lit("Bearer ab.c= sk-x1 "), "text")).alias("detail"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents), p AS (SELECT *, left(t, 5999) AS p FROM t),
e AS (SELECT *, length(regexp_extract(p, '(?s)^(.*)([.!?]( |$)|[。！？])', 1)) AS s, regexp_matches(p, '(?s)[.!?]( |$)|[。！？]') AS ends, length(p) - strpos(reverse(p), ' ') AS b, contains(p, ' ') AS blank FROM p)
SELECT doc_id, md5(CASE WHEN length(t) <= 6000 THEN t WHEN ends AND s >= 4200 THEN left(p, s + 1) || '…' WHEN blank AND b >= 4800 THEN rtrim(left(p, b)) || '…' ELSE rtrim(p) || '…' END) AS digest FROM e""")
def paper_contexts(spark, sf_dir):
    """STR15."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.limit_context(F.col("text"))).alias("digest"))


GENERATED = ["a\\nb", "a\\n b\\t.", "x\n \t\n\n y", "costs $5", "$a$", "`` ```", "⟪P0", "plain"]


@query(f"""WITH g AS (SELECT o_orderkey, {form_sql(GENERATED, "o_orderkey")} AS g FROM orders)
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'a' || chr(10) || ' b' || chr(9) || '.' WHEN 2 THEN 'x  y' ELSE g END AS prose, CASE WHEN o_orderkey % 8 IN (0, 4) THEN 'extra_command' WHEN o_orderkey % 8 IN (5, 6) THEN 'invalid_format' END AS error FROM g""")
def generated_prose(spark, sf_dir):
    """STR17, VL1."""
    prose = text.normalize_generated(form(GENERATED, "o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", prose.alias("prose"), text.generated_error(prose).alias("error"))


@query("""WITH i AS (SELECT user_id AS page, event_id AS ord, event_id % 9 AS n FROM events), p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM i),
m AS (SELECT c_custkey AS match_id, c_custkey % 64 AS page, c_custkey % 400 AS s, c_custkey % 25 AS k FROM customer)
SELECT p.page, match_id, ord, CAST(greatest(s, a) - a AS BIGINT) AS "from", CAST(least(s + k, a + n) - a AS BIGINT) AS "to" FROM p JOIN m ON p.page = m.page WHERE least(s + k, a + n) > greatest(s, a)""")
def match_slices(spark, sf_dir):
    """JN8: events are the text items of their user's page, customers the matches."""
    items = read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ord"), (F.col("event_id") % 9).alias("length"))
    c = F.col("c_custkey")
    return align.slices_of_matches(items, read(spark, sf_dir, "customer").select(c.alias("match_id"), (c % 64).alias("page"), (c % 400).alias("start"), (c % 25).alias("size")))


@query("""WITH r AS (SELECT c_custkey % 9 AS pair, c_custkey % 50 AS page, c_custkey % 7 / 10 AS a, c_custkey % 7 / 10 + c_custkey % 4 / 10 AS b FROM customer), h AS (SELECT event_id, count(*) AS n, min(0.2 + (event_id % 100 / 100 - a) / (b - a) * 0.4) AS f FROM events JOIN r ON user_id % 9 = pair AND event_id % 50 = page WHERE b > a AND event_id % 100 / 100 BETWEEN a AND b GROUP BY 1)
SELECT event_id AS position_id, CAST(event_id % 50 + 1 AS BIGINT) AS page, round(f, 9) AS fraction FROM h WHERE n = 1""")
def region_positions(spark, sf_dir):
    """JN5: positions in exactly one figure."""
    k, e = F.col("c_custkey"), F.col("event_id")
    start = k % 7 / 10
    regions = read(spark, sf_dir, "customer").select((k % 9).alias("pair_id"), (k % 50).alias("source_page"), start.alias("source_start"), (start + k % 4 / 10).alias("source_end"), (k % 50 + 1).alias("target_page"), F.lit(0.2).alias("target_start"), F.lit(0.6).alias("target_end"))
    positions = read(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("pair_id"), e.alias("position_id"), (e % 50).alias("page"), (e % 100 / 100).alias("fraction"))
    return align.in_one_region(positions, regions).select("position_id", "page", F.round("fraction", 9).alias("fraction"))


@query("""WITH w AS (SELECT o_custkey AS project, o_orderkey AS include_id, ['main', 'sub', ''] AS b, 'f' || (o_orderkey % 6) AS n FROM orders), f AS (SELECT DISTINCT o_custkey AS project, CASE o_orderkey % 4 WHEN 0 THEN 'main/' WHEN 1 THEN 'sub/' ELSE '' END || 'f' || (o_custkey % 6) || CASE WHEN o_orderkey % 5 < 3 THEN '.tex' ELSE '' END AS path FROM orders),
t AS (SELECT project, include_id, unnest(['main/' || n, 'main/' || n || '.tex', 'sub/' || n, 'sub/' || n || '.tex', n, n || '.tex']) AS path, unnest([0, 1, 2, 3, 4, 5]) AS i FROM w)
SELECT project, include_id, arg_min(path, i) AS path FROM t JOIN f USING (project, path) GROUP BY 1, 2""")
def include_lookup(spark, sf_dir):
    """JN10: the first of three folders that holds the name, with or without its ending."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf_dir, "orders")
    folder = F.when(k % 4 == 0, "main/").when(k % 4 == 1, "sub/").otherwise("")
    files = o.select(c.alias("project"), F.concat(folder, F.lit("f"), (c % 6).cast("string"), F.when(k % 5 < 3, ".tex").otherwise("")).alias("path")).distinct()
    wanted = o.select(c.alias("project"), k.alias("include_id"), F.concat(F.lit("f"), (k % 6).cast("string")).alias("name"), F.lit("main").alias("main_dir"), F.lit("sub").alias("file_dir"), F.lit("").alias("root_dir"))
    return graph.resolve_includes(wanted, files)


@query("""WITH f AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN './' ELSE 'fig/' END || 'g' || (p_partkey // 4) || CASE WHEN p_partkey % 5 < 2 THEN '.pdf' ELSE '.png' END AS path FROM part), t AS (SELECT p_partkey AS asset_id, unnest(['./g' || p_partkey || '.pdf', 'fig/g' || p_partkey || '.pdf', './g' || p_partkey || '.png', 'fig/g' || p_partkey || '.png']) AS path, unnest([0, 1, 2, 3]) AS i FROM part)
SELECT asset_id, arg_min(path, i) AS path FROM t JOIN f USING (path) GROUP BY 1""")
def asset_paths(spark, sf_dir):
    """JN13: endings before folders."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part")
    files = p.select(F.concat(F.when(k % 3 == 0, "./").otherwise("fig/"), F.lit("g"), F.floor(k / 4).cast("string"), F.when(k % 5 < 2, ".pdf").otherwise(".png")).alias("path")).distinct()
    return graph.asset_lookup(p.select(k.alias("asset_id"), F.concat(F.lit("g"), k.cast("string")).alias("name")), files, (".pdf", ".png"), ("./", "fig/"))


@query("SELECT 0 AS project, p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AND p_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def translated_files(spark, sf_dir):
    """ST3: files without the opaque and the mixed ones."""
    node = lambda d, c: d.select(F.lit(0).alias("project"), F.col(c).alias("node"))
    mixed = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return graph.translation_files(node(read(spark, sf_dir, "part"), "p_partkey"), [node(read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"), "o_custkey"), node(mixed, "c_custkey")])


@query("""WITH l AS (SELECT user_id AS pair_id, event_id % 40 AS o, event_id % 3 AS w, printf('%09d', event_id) AS name FROM events) SELECT pair_id, name, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY o, w DESC, name) AS INTEGER) AS place FROM l""")
def landmark_places(spark, sf_dir):
    """RK8."""
    e = F.col("event_id")
    pairs = read(spark, sf_dir, "events").select(F.col("user_id").alias("pair_id"), (e % 40).alias("original"), (e % 3).alias("weight"), F.format_string("%09d", e).alias("name"))
    return align.landmark_order(pairs).select("pair_id", "name", "place")


XML_SQL = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _masked(spark, sf_dir):
    masked = F.concat(F.lit("⟪P0000⟫ "), "text", F.lit("⟪P0001⟫"))
    return texts(spark, sf_dir).select("doc_id", masked.alias("masked"), F.array(F.lit("$x<1$"), F.lit("\\textbf{")).alias("protected"))


@query(f"""SELECT doc_id, md5('<p><ph id="P0000">$x&lt;1$</ph> ' || {XML_SQL} || '<ph id="P0001">P0001</ph></p>') AS xml, md5('⟪P0000⟫ ' || text || '⟪P0001⟫') AS back, CAST(NULL AS VARCHAR) AS error FROM documents""")
def xml_transport(spark, sf_dir):
    """VL4: every text between a movable and a fixed marker, as XML and back."""
    d = _masked(spark, sf_dir).select("doc_id", frames.transported("masked", "protected").alias("t"))
    return d.select("doc_id", F.md5("t.xml").alias("xml"), F.md5("t.back").alias("back"), "t.error")


@query("""SELECT doc_id, '⟪P0000⟫ ' || text || '⟪P0001⟫' AS paragraph, '$x<1$' AS value, ['⟪P0001⟫'] AS fixed FROM documents""")
def request_payloads(spark, sf_dir):
    """EX2: the payload's fields, read back from its JSON."""
    d = _masked(spark, sf_dir).select("doc_id", F.from_json(frames.payloads("masked", "protected", F.lit("")), "paragraph string, value_tokens map<string,string>, fixed_format_order array<string>").alias("j"))
    return d.select("doc_id", "j.paragraph", F.try_element_at("j.value_tokens", F.lit("⟪P0000⟫")).alias("value"), F.col("j.fixed_format_order").alias("fixed"))


SOURCE = "The results are shown in this table and we use them"


@query("""WITH v AS (SELECT doc_id, doc_id % 3 = 0 AS x, CASE doc_id % 4 WHEN 0 THEN '<think>a</think> ' || text WHEN 1 THEN text WHEN 2 THEN '<think>' || text ELSE '译文' || text END AS raw, text FROM documents),
s AS (SELECT *, CASE WHEN x THEN raw WHEN doc_id % 4 = 2 THEN NULL ELSE trim(CASE WHEN doc_id % 4 = 0 THEN text ELSE raw END, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') END AS s FROM v),
n AS (SELECT *, len(regexp_extract_all(s, '[A-Za-z]{2,}')) AS w, len(regexp_extract_all(s, '[\\x{3400}-\\x{9fff}]')) AS c FROM s),
e AS (SELECT *, CASE WHEN s IS NULL THEN 'ambiguous' WHEN c = 0 THEN 'not_translated' WHEN w > 8.8 AND c < 1.65 THEN 'mostly_source' END AS error FROM n)
SELECT doc_id, error, CASE WHEN error IS NULL THEN md5(s) END AS digest FROM e""")
def cached_values(spark, sf_dir):
    """VL3, STR14: answers with reasoning, without, with a tag left open, and in the language asked for; a third are an XML service's."""
    k = F.col("doc_id") % 4
    value = F.when(k == 0, F.concat(F.lit("<think>a</think> "), "text")).when(k == 1, F.col("text")).when(k == 2, F.concat(F.lit("<think>"), "text")).otherwise(F.concat(F.lit("译文"), "text"))
    read_back = frames.cached_value(F.col("value"), F.lit(SOURCE), F.lit("zh-hans"), F.when(F.col("doc_id") % 3 == 0, "deepl").otherwise("custom"))
    return texts(spark, sf_dir).select("doc_id", value.alias("value")).select("doc_id", read_back.alias("r")).select("doc_id", "r.error", F.md5("r.value").alias("digest"))


FILES = ["main.tex", "sub/ms.tex", "a.tex", "sub/b.tex", "main.txt", "c.tex"]
BODIES = ["\\documentclass{a}\n\\begin{document}\nsome text", "\\documentclass{a}\n\\begin{document}\n一二三 text", "% \\documentclass{a}\n\\begin{document}x", "\\documentclass{a} text", "\\documentclass{a}\n\\begin{document}\n一二三四五 text"]


@query(f"""WITH f AS (SELECT o_custkey AS project, o_orderkey AS k, o_orderkey % 6 AS p, (o_orderkey // 6) % 5 AS b, o_orderkey || '/' || {form_sql(FILES, "o_orderkey")} AS path FROM orders),
r AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY b = 4, p >= 2, CASE WHEN p IN (1, 3) THEN 3 ELSE 2 END, -(k % 100), path) AS r FROM f WHERE p <> 4 AND b IN (0, 1, 4))
SELECT project, path AS main FROM r WHERE r = 1""")
def main_files(spark, sf_dir):
    """RK3: orders are the files of their customer's project."""
    o = read(spark, sf_dir, "orders").withColumn("_b", F.floor(F.col("o_orderkey") / 6))
    path = F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), form(FILES, "o_orderkey"))
    return archives.main_files(o.select(F.col("o_custkey").alias("project"), path.alias("path"), form(BODIES, "_b").alias("text"), (F.col("o_orderkey") % 100).alias("size")))


@query("""WITH p AS (SELECT user_id AS pair_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, user_id % 4 AS m FROM events),
s AS (SELECT *, lag(event_id) OVER w AS o, lag(CASE WHEN m = 0 THEN place % 5 ELSE place END) OVER w AS b, CASE WHEN m = 0 THEN place % 5 ELSE place END AS t FROM p WINDOW w AS (PARTITION BY pair_id ORDER BY place))
SELECT pair_id, bool_and(o IS NULL OR (event_id > o AND t > b)) AS ordered FROM s GROUP BY 1""")
def rising_landmarks(spark, sf_dir):
    """RK11: some pairs' translated places fall back."""
    e = read(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = e.select(F.col("user_id").alias("pair_id"), F.col("event_id").alias("original"), place.alias("place"))
    return align.rising(pairs.withColumn("translated", F.when(F.col("pair_id") % 4 == 0, F.col("place") % 5).otherwise(F.col("place"))))


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS bad, CASE o_orderkey % 5 WHEN 0 THEN '⟪P0000⟫ 译文' WHEN 1 THEN '译文译' WHEN 2 THEN NULL ELSE o_orderpriority END AS output FROM orders)
SELECT count(*) AS segments, count(*) FILTER (NOT bad AND output IS NOT NULL) AS validated, count(*) FILTER (bad) AS refused, count(*) FILTER (contains(output, '⟪')) AS leaks, CAST(sum(CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN NULL ELSE 0 END) AS BIGINT) AS letters FROM s""")
def translation_audit(spark, sf_dir):
    """AG12."""
    k = F.col("o_orderkey")
    output = F.when(k % 5 == 0, "⟪P0000⟫ 译文").when(k % 5 == 1, "译文译").when(k % 5 != 2, F.col("o_orderpriority"))
    found = records.audit(read(spark, sf_dir, "orders").select(output.alias("output"), F.when(k % 3 == 0, "refused").alias("error")))
    return found.toDF("segments", "validated", "refused", "leaks", "letters")


@query("""SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 25 END IS NOT DISTINCT FROM CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END""")
def same_artifacts(spark, sf_dir):
    """FP10: notes of orders and of their customers; two absent languages are equal."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    fixed = [F.lit("texts").alias("artifact"), F.lit(None).cast("string").alias("arxiv_id")]
    a = read(spark, sf_dir, "orders").select(k, F.col("o_custkey").alias("task_id"), F.when(k % 7 != 0, k % 25).alias("language"), *fixed)
    b = read(spark, sf_dir, "customer").select(c.alias("task_id"), F.when(c % 3 != 0, F.col("c_nationkey")).alias("language"), *fixed)
    return a.join(b, records.same_artifact(a, b)).select("o_orderkey", a["task_id"].alias("o_custkey"))


@query("""WITH c AS (SELECT event_id AS name, user_id % 9 AS pair, event_id % 50 AS p, event_id % 100 / 100 AS f FROM events), g AS (SELECT c_custkey % 9 AS pair, c_custkey % 50 AS p, c_custkey % 11 AS s, c_custkey % 7 / 10 AS a, c_custkey % 7 / 10 + 0.2 AS b FROM customer),
r AS (SELECT c.name, min(l.s) AS signature, count(*) AS n FROM c JOIN g l ON l.pair = c.pair AND l.p = c.p AND c.f >= l.a - 0.065::DOUBLE AND c.f <= l.b + 0.065::DOUBLE JOIN g r ON r.pair = c.pair AND r.p = c.p AND r.s = l.s AND c.f >= r.a - 0.065::DOUBLE AND c.f <= r.b + 0.065::DOUBLE GROUP BY 1)
SELECT name, signature FROM r WHERE n = 1""")
def figure_regions(spark, sf_dir):
    """JN2: captions whose figure is the only one of its signature on both sides."""
    e, k = F.col("event_id"), F.col("c_custkey")
    captions = read(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("pair_id"), e.alias("name"), (e % 50).alias("original_page"), (e % 50).alias("translated_page"), (e % 100 / 100).alias("original_fraction"), (e % 100 / 100).alias("translated_fraction"))
    side = lambda s: read(spark, sf_dir, "customer").select((k % 9).alias("pair_id"), F.lit(s).alias("side"), (k % 50).alias("page"), (k % 11).alias("signature"), (k % 7 / 10).alias("start"), (k % 7 / 10 + 0.2).alias("end"))
    return align.match_regions(captions, side("original").unionByName(side("translated"))).select("name", "signature")


@query("""WITH x AS (SELECT doc_id, translate(text, '%$&<>{}' || chr(92), '') AS text FROM documents)
SELECT doc_id, md5(chr(92) || 'begin{figure}[tb]' || chr(10) || text || chr(10) || chr(92) || 'vspace{0pt} 3bp' || chr(10) || chr(92) || 'end{figure}') AS digest, 1 AS n FROM x""")
def rewritten_floats(spark, sf_dir):
    """RW1, RW2, RW5: a float around each text, without its signs of TeX, loses an unknown position, a negative space and pixels."""
    tex = F.concat(F.lit("\\begin{figure}[tXb]\n"), F.translate("text", "%$&<>{}\\", ""), F.lit("\n\\vspace{-3mm} 3px\n\\end{figure}"))
    edited = frames.negative_spacers(frames.pixel_units(frames.float_positions(tex)))
    return texts(spark, sf_dir).select("doc_id", edited.alias("r")).select("doc_id", F.md5("r.text").alias("digest"), F.col("r.count").alias("n"))
