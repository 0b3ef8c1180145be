"""Queries of regions on pages, chains, batches and interval joins over ordered tables."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from texloom.operators import library, regions
from texloom.plans import tables
from texloom.queries import query, read
from texloom.sources import archives
from texloom.streaming import changes
from texloom.tex import tokens

TURN = "CASE event_id % 5 WHEN 0 THEN [0, 1, -1, 0, 0, 0] WHEN 1 THEN [-1, 0, 0, 1, 5, 0] ELSE [1, 0, 0, 1, event_id % 9 - 4, event_id % 11 - 5] END"


@query(f"""WITH RECURSIVE o AS (SELECT user_id AS p, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 7 AS k, CAST({TURN} AS DOUBLE[]) AS a FROM events),
w AS (SELECT DISTINCT p, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST([1, 0, 0, 1, 0, 0] AS DOUBLE[]) AS m, CAST([] AS DOUBLE[][]) AS s FROM o
 UNION ALL SELECT w.p, o.i, o.n, o.k, CASE WHEN o.k IN (2, 3) THEN [a[1] * m[1] + a[2] * m[3], a[1] * m[2] + a[2] * m[4], a[3] * m[1] + a[4] * m[3], a[3] * m[2] + a[4] * m[4], a[5] * m[1] + a[6] * m[3] + m[5], a[5] * m[2] + a[6] * m[4] + m[6]]
  WHEN o.k = 1 THEN coalesce(s[len(s)], [1, 0, 0, 1, 0, 0]) ELSE m END, CASE o.k WHEN 0 THEN list_append(s, m) WHEN 1 THEN list_slice(s, 1, len(s) - 1) ELSE s END FROM w JOIN o ON o.p = w.p AND o.n = w.n + 1),
d AS (SELECT p, i, 'x' || i % 4 AS signature, p % 4 * 90 AS r, i % 4 * 15 + 5 AS x, i % 3 * 20 + 2 AS y, m FROM w WHERE k > 3 AND i % 4 < 3),
c AS (SELECT p, i, signature, r, least(m[5], m[5] + x * m[1]) + least(0, y * m[3]) AS x0, greatest(m[5], m[5] + x * m[1]) + greatest(0, y * m[3]) AS x1, least(m[6], m[6] + x * m[2]) + least(0, y * m[4]) AS y0, greatest(m[6], m[6] + x * m[2]) + greatest(0, y * m[4]) AS y1 FROM d),
f AS (SELECT p, i, signature, CASE r WHEN 90 THEN (x0 + 64) / 128 WHEN 180 THEN (y0 + 64) / 128 WHEN 270 THEN 1 - (x1 + 64) / 128 ELSE (64 - y1) / 128 END AS a, CASE r WHEN 90 THEN (x1 + 64) / 128 WHEN 180 THEN (y1 + 64) / 128 WHEN 270 THEN 1 - (x0 + 64) / 128 ELSE (64 - y0) / 128 END AS b FROM c WHERE (x1 - x0) / 128 >= 0.1 AND (y1 - y0) / 128 >= 0.04)
SELECT p AS page_id, i AS ord, signature, greatest(a, 0) AS "start", least(b, 1) AS "end" FROM f WHERE least(b, 1) > greatest(a, 0)""")
def page_regions(spark, sf_dir):
    """SC13, AR5: events are the drawing operations of their user's page: saves, restores, turns and figures."""
    e = read(spark, sf_dir, "events")
    i, k = F.col("event_id"), F.col("event_id") % 7
    lit = lambda *x: F.array(*[(v if not isinstance(v, (int, float)) else F.lit(v)).cast("double") for v in x])
    turn = F.when(i % 5 == 0, lit(0, 1, -1, 0, 0, 0)).when(i % 5 == 1, lit(-1, 0, 0, 1, 5, 0)).otherwise(lit(1, 0, 0, 1, i % 9 - 4, i % 11 - 5))
    op = F.when(k == 0, "q").when(k == 1, "Q").when(k.isin(2, 3), "cm").otherwise("Do")
    name = F.concat_ws("-", (i % 4).cast("string"), (i % 3).cast("string"))
    operations = e.select(F.col("user_id").alias("page_id"), i.alias("ord"), op.alias("op"), F.when(op == "cm", turn).alias("args"), F.when(op == "Do", name).alias("name"))
    pages = e.select(F.col("user_id").alias("page_id")).distinct().select("page_id", *[F.lit(v).alias(n) for n, v in (("left", -64.0), ("bottom", -64.0), ("right", 64.0), ("top", 64.0))], (F.col("page_id") % 4 * 90).cast("int").alias("rotation"))
    kinds = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("name"), F.lit("/Form" if a < 3 else "/PS").alias("subtype"), lit(0, 0, a * 15 + 5, b * 20 + 2).alias("bounds"), F.lit(f"x{a}").alias("signature")) for a in range(4) for b in range(3)]))
    objects = pages.select("page_id", kinds.alias("o")).select("page_id", "o.*", F.lit(None).cast("array<double>").alias("matrix"))
    return regions.graphic_regions(operations, objects, pages)


def _archive(group: pd.DataFrame) -> pd.DataFrame:
    """One archive of a group's documents: zip, tar, tar.gz, or a gz of the first; in three character sets, with members that are passed over or refused."""
    number = int(group["archive"].iloc[0])
    files = [(f"src/d{doc}.tex", text.encode(("utf-8-sig", "gb18030", "utf-8")[doc % 3])) for doc, text in sorted(zip(group["doc_id"].tolist(), group["text"].tolist()))]
    first = files[0][1]
    files += [("__MACOSX/x.tex", b"x"), ("./.git/config", b"x")] + ([("../up.tex", b"x")] if number % 5 == 3 else [])
    blob = io.BytesIO()
    if number % 5 == 4:
        blob.write(gzip.compress(first, mtime=0))
    elif number % 5 in (0, 3):
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in files:
                z.writestr(name, content)
    else:
        with tarfile.open(fileobj=blob, mode="w:gz" if number % 5 == 1 else "w") as t:
            for name, content in files:
                info = tarfile.TarInfo(name)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
            if number % 10 == 2:
                info = tarfile.TarInfo("link.tex")
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(info)
    return pd.DataFrame({"path": [f"a{number}"], "content": [blob.getvalue()]})


@query(r"""WITH d AS (SELECT doc_id, doc_id // 8 AS a, text, min(doc_id) OVER (PARTITION BY doc_id // 8) AS first FROM documents),
bad AS (SELECT DISTINCT a, CASE WHEN a % 5 = 3 THEN 'unsafe_path' ELSE 'link' END AS error FROM d WHERE a % 5 = 3 OR a % 10 = 2)
SELECT 'a' || a AS project, CASE WHEN a % 5 = 4 THEN 'main.tex' ELSE 'src/d' || doc_id || '.tex' END AS path, sha256(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM d
 WHERE a NOT IN (SELECT a FROM bad) AND (a % 5 <> 4 OR doc_id = first)
UNION ALL SELECT 'a' || a, NULL, NULL, error FROM bad""")
def archive_members(spark, sf_dir):
    """SC2, SC3, SC4: archives packed from documents, eight to each, and read again."""
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.floor(F.col("doc_id") / 8).cast("long").alias("archive"), "doc_id", "text")
    found = archives.expand(d.groupBy("archive").applyInPandas(_archive, "path string, content binary"))
    return found.select("project", "path", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "error")


@query("""WITH RECURSIVE e AS (SELECT user_id AS id, event_id, event_id % 3 AS asked, event_id % 97 = 0 AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS revision, false AS deleted, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS refused FROM e
 UNION ALL SELECT w.id, e.n, CASE WHEN ok THEN revision + 1 ELSE revision END, CASE WHEN ok THEN w.gone ELSE deleted END, CASE WHEN ok THEN w.event_id ELSE last END, CASE WHEN ok THEN applied + 1 ELSE applied END, CASE WHEN ok THEN refused ELSE refused + 1 END
 FROM (SELECT w.*, e.n AS en, e.gone, e.event_id, NOT deleted AND e.asked = revision % 3 AS ok FROM w JOIN e ON e.id = w.id AND e.n = w.n + 1) w JOIN e ON e.id = w.id AND e.n = w.en)
SELECT id, revision, deleted, last AS changed_by, applied, refused FROM w QUALIFY n = max(n) OVER (PARTITION BY id)""")
def annotation_patches(spark, sf_dir):
    """UP1: events are the changes of their user's annotation, which name a revision by its remainder."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), (F.col("event_id") % 3).alias("asked"), (F.col("event_id") % 97 == 0).alias("gone"), F.col("event_id").alias("value"))
    return changes.patched_batch(e, modulus=3).select("id", "revision", "deleted", F.col("value").alias("changed_by"), "applied", "refused")


@query("""SELECT user_id AS document, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7, event_id % 11 / 11.0, event_id % 13, event_id) AS BIGINT) AS place FROM events""")
def annotation_places(spark, sf_dir):
    """RK5: the place of each annotation of a document by page, top of its first rectangle and creation."""
    i = F.col("event_id")
    rect = lambda y: F.struct((i % 5 / 5.0).alias("x"), y.alias("y"))
    anchors = F.array(F.struct((i % 7).cast("int").alias("page"), F.array(rect(i % 11 / 11.0), rect(i % 2 / 2.0)).alias("rects")), F.struct(F.lit(0).alias("page"), F.array(rect(F.lit(0.0))).alias("rects")))
    a = read(spark, sf_dir, "events").select(F.col("user_id").alias("document"), i.alias("id"), anchors.alias("anchors"), (i % 13).alias("created_at"))
    return library.reading_places(a).select("document", "id", "place")


@query("""SELECT DISTINCT trim(p) AS path FROM (SELECT unnest(string_split(replace(url, '://', '/'), '/')) AS p FROM pages) WHERE trim(p) <> '' AND length(p) % 3 = 0""")
def recorded_files(spark, sf_dir):
    """SC10: the distinct inputs of a recorder's lines, made of the parts of all urls; other lines record something else."""
    part = F.explode(F.split(F.regexp_replace("url", "://", "/"), "/"))
    lines = read(spark, sf_dir, "pages").select(part.alias("p")).where("trim(p) <> ''").select(F.concat(F.when(F.length("p") % 3 == 0, "INPUT ").otherwise("OUTPUT "), F.col("p")).alias("value"))
    return archives.recorded_inputs(lines)


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN './d' || doc_id || '.tex' WHEN 1 THEN 'https://example.org/' || doc_id || '.zip' WHEN 2 THEN '# d' || doc_id || '.tex' WHEN 3 THEN '  ' ELSE ' 2401.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || ' ' END AS v FROM documents)
SELECT CASE WHEN doc_id % 5 = 0 THEN 'list/' || v ELSE trim(v) END AS source, count(*) AS n FROM l WHERE doc_id % 5 NOT IN (2, 3) GROUP BY 1""")
def batch_sources(spark, sf_dir):
    """SC9: lists written from documents, a line each, and read again: local names below their list's folder, blank lines and comments left out."""
    i = F.col("doc_id")
    k = i % 5
    name = F.when(k == 0, F.concat(F.lit("./d"), i.cast("string"), F.lit(".tex"))).when(k == 1, F.concat(F.lit("https://example.org/"), i.cast("string"), F.lit(".zip"))).when(k == 2, F.concat(F.lit("# d"), i.cast("string"), F.lit(".tex"))).when(k == 3, "  ")
    lines = read(spark, sf_dir, "documents").select(name.otherwise(F.concat(F.lit(" 2401."), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit(" "))).alias("value"))
    folder = tables.folder(spark, "lists") + "/list"
    lines.write.text(folder)
    found = archives.batch_list(spark, folder)
    here = F.regexp_replace("source", r"^.*/list/", "list/")
    return found.select(here.alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*/?(.*)$', 1) AS rest FROM pages),
n AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/' || rest WHEN 1 THEN '../' || rest WHEN 2 THEN 'a/../../../' || rest WHEN 3 THEN '|' || rest WHEN 4 THEN 'c:/' || rest ELSE 'a/' || rest END AS name FROM p)
SELECT page_id, CASE WHEN regexp_matches(name, '^([/~|]|[A-Za-z]:)') OR starts_with(name, 'a/../../../') THEN [name] ELSE [] END AS violations FROM n""")
def path_violations(spark, sf_dir):
    """FP7: includes of the paths of all urls, in braces or not, seen from a main file in a folder; those in comments are none."""
    rest = F.regexp_extract("url", r"^[^:]*://[^/]*/?(.*)$", 1)
    k = F.col("page_id") % 6
    name = F.concat(F.when(k == 0, "/").when(k == 1, "../").when(k == 2, "a/../../../").when(k == 3, "|").when(k == 4, "c:/").otherwise("a/"), rest)
    call = F.when(k == 1, F.concat(F.lit("\\openin "), name, F.lit(" "))).when(k == 3, F.concat(F.lit("\\input"), name)).otherwise(F.concat(F.lit("\\includegraphics[width=1cm] { "), name, F.lit(" }")))
    tex = F.concat(F.lit("% \\input{/etc/x}\n"), call, F.lit("\n\\inputs{/y} \\verb|\\input{/z}|"))
    return read(spark, sf_dir, "pages").select("page_id", tokens.path_violations(tokens.visible(tex), F.lit("src/main.tex")).alias("violations"))
