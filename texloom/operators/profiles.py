"""Settings and profiles, links to jobs, library items, and small picks over arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.functions import ids

# The fields of a payload that hold text for readers.
MESSAGE_FIELDS = ("message", "error", "detail", "msg", "warnings")
SECRETS = ("api_key", "extra_headers")


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def public(settings: DataFrame) -> DataFrame:
    """PR1: settings without secrets, and whether there is a key."""
    return settings.withColumn("has_api_key", _filled(F.col("api_key"))).drop(*SECRETS)


def options(presets: DataFrame, saved: DataFrame) -> DataFrame:
    """PR7: (provider, base_url, model, has_api_key, saved): the last profile saved (provider, ordinal, base_url, model, api_key), else the preset.

    max_by combines map-side, and presets have one row a provider.
    """
    last = saved.groupBy("provider").agg(F.max_by(F.struct("base_url", "model", "api_key"), "ordinal").alias("_s"))
    both = presets.join(last, "provider", "left")
    has = F.col("_s").isNotNull()
    chosen = lambda c: F.when(has, F.col(f"_s.{c}")).otherwise(F.col(c))
    return both.select("provider", chosen("base_url").alias("base_url"), chosen("model").alias("model"), (has & _filled(F.col("_s.api_key"))).alias("has_api_key"), has.alias("saved"))


def merge(old: DataFrame, new: DataFrame, saved: DataFrame) -> DataFrame:
    """PR8: settings by id after a change whose NULL fields keep what there was.

    Another address takes its key and headers from its own saved profile only, by (id, base_url);
    clear_api_key removes a kept key, and a new key wins over it.
    """
    o, n, s = (df.select("id", F.struct(*[c for c in df.columns if c != "id"]).alias(a)) for df, a in ((old, "o"), (new, "n"), (saved, "s")))
    both = o.join(n, "id", "left").withColumn("_url", F.coalesce("n.base_url", "o.base_url"))
    profile = s.groupBy("id", F.col("s.base_url").alias("_url")).agg(F.first("s").alias("s"))
    both = both.join(profile, ["id", "_url"], "left")
    moved = F.col("_url") != F.col("o.base_url")
    key = (
        F.when(_filled(F.col("n.api_key")), F.col("n.api_key")).when(F.coalesce("n.clear_api_key", F.lit(False)), "")
        .when(moved, F.coalesce("s.api_key", F.lit(""))).otherwise(F.col("o.api_key"))
    )
    none = F.create_map().cast("map<string,string>")
    headers = F.coalesce("n.extra_headers", F.when(moved, F.coalesce("s.extra_headers", none)).otherwise(F.col("o.extra_headers")))
    return both.select("id", F.col("_url").alias("base_url"), F.coalesce("n.model", "o.model").alias("model"), key.alias("api_key"), headers.alias("extra_headers"))


def deep_link(url: Column) -> Column:
    """PR6: the job and the view that an address names as a struct (id, view), or NULL."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    has = lambda k: query.rlike(rf"(?:^|&){k}(?:=|&|$)")
    value = lambda k: F.try_url_decode(F.regexp_extract(query, rf"(?:^|&){k}=([^&]*)", 1))
    job = F.when(has("job"), value("job")).when(has("reader"), value("reader"))
    reader = (has("reader") & ~has("job")) | F.coalesce(value("view") == "reader", F.lit(False))
    return F.when(job.rlike(r"\A[a-zA-Z0-9_-]{1,128}\z"), F.struct(job.alias("id"), F.when(reader, "reader").otherwise("details").alias("view")))


def resolve_links(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """PR6: links with (id, view) and what they open: missing, details or reader; jobs are (id, translated)."""
    found = links.join(jobs.select("id", "translated", F.lit(True).alias("_there")), "id", "left")
    opens = F.when(F.col("_there").isNull(), "missing").when((F.col("view") == "reader") & F.coalesce("translated", F.lit(False)), "reader").otherwise("details")
    return found.withColumn("opens", opens).drop("_there", "translated")


def authored_files(files: DataFrame, managed: DataFrame) -> DataFrame:
    """JN12: files without the byte-identical libraries of a runtime, by name and digest."""
    return files.join(managed.select("name", "digest").distinct(), ["name", "digest"], "left_anti")


def live_children(asked: DataFrame, items: DataFrame) -> DataFrame:
    """JN15: (id, parent, child) for asked ids: the parent of an attachment (an item without parent_id is its own) and its distinct children that are not deleted."""
    own = asked.select("id").distinct().join(items.select("id", "parent_id"), "id")
    parents = own.select("id", F.coalesce("parent_id", "id").alias("parent"))
    children = items.where("parent_id is not null and not coalesce(deleted, false)").select(F.col("parent_id").alias("parent"), F.col("id").alias("child")).distinct()
    return parents.join(children, "parent").select("id", "parent", "child")


def completed_sources(selections: DataFrame, resolved: DataFrame) -> DataFrame:
    """JN16: (id, paper_id, state) of selections (id, paper_id, official, originals, evidence, accepted) by resolved (base, version).

    kept: no paper or a version of its own; conflict: no version of the same paper is known;
    none: the official version would replace originals and was not accepted; else official.
    """
    base = ids.base_id(F.col("paper_id"))
    known = resolved.groupBy(F.col("base").alias("_base")).agg(F.first("version").alias("_version"))
    both = selections.withColumn("_base", base).join(known, "_base", "left")
    has_version = F.coalesce(ids.is_versioned(F.col("paper_id")), F.lit(False))
    version = F.when(has_version, F.col("paper_id")).otherwise(F.col("_version"))
    good = F.coalesce((ids.base_id(version) == F.col("_base")) & ids.is_versioned(version), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    state = (
        F.when(F.col("paper_id").isNull() | (has_version & ~flag("official")), "kept").when(~good, "conflict")
        .when((F.col("originals") > 0) & ~F.col("evidence").eqNullSafe(F.lit("attachment")) & ~flag("accepted"), "none").otherwise("official")
    )
    done = both.withColumn("state", state)
    paper = F.when(F.col("state") == "kept", F.col("paper_id")).when(F.col("state") == "official", version)
    return done.select("id", paper.alias("paper_id"), "state")


def merged_rects(rects: Column) -> Column:
    """RK13: rectangles (x, y, width, height) in the order of y and x, each joined to the first earlier one on its line that it touches."""
    placed = F.transform(rects, lambda r, i: F.struct(r["y"].alias("y"), r["x"].alias("x"), i.alias("i"), r["width"].alias("width"), r["height"].alias("height")))
    ordered = F.transform(F.array_sort(placed), lambda r: F.struct(*[r[c].cast("double").alias(c) for c in ("x", "y", "width", "height")]))
    touches = lambda p, r: (F.abs(p["y"] - r["y"]) < 0.002) & (F.abs(p["height"] - r["height"]) < 0.004) & (r["x"] <= p["x"] + p["width"] + 0.002) & (r["x"] + r["width"] >= p["x"])

    def joined(p: Column, r: Column) -> Column:
        left = F.least(p["x"], r["x"])
        right = F.greatest(p["x"] + p["width"], r["x"] + r["width"])
        return F.struct(left.alias("x"), p["y"].alias("y"), (right - left).alias("width"), p["height"].alias("height"))

    def step(held: Column, r: Column) -> Column:
        first = F.array_position(F.transform(held, lambda p: touches(p, r)), True)
        return F.when(first == 0, F.concat(held, F.array(r))).otherwise(F.transform(held, lambda p, i: F.when(i + 1 == first, joined(p, r)).otherwise(p)))

    none = F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")
    return F.aggregate(ordered, none, step)


def only_asset(assets: Column, name: Column, base: Column, tag: Column, limit: int) -> Column:
    """RK18: the only asset of a name, if it is uploaded, where it belongs and of a size within the limit; else NULL."""
    named = F.filter(assets, lambda a: a["name"] == name)
    a = F.get(named, 0)
    good = (F.size(named) == 1) & (a["state"] == "uploaded") & (a["url"] == F.concat(base, F.lit("/releases/download/"), tag, F.lit("/"), name)) & (a["size"] > 0) & (a["size"] <= limit)
    return F.when(good, a)


def midpoint_ordinals(columns: DataFrame) -> DataFrame:
    """RK19: (view, ordinal) between the title column and the next one, from (view, position, key, ordinal); without a title from 0, without a next one half a step on."""
    title = columns.groupBy("view").agg(F.coalesce(F.min_by("ordinal", F.when(F.col("key") == "title", F.col("position"))), F.lit(0)).alias("_title"))
    after = columns.join(title, "view").groupBy("view", "_title").agg(F.min(F.when(F.col("ordinal") > F.col("_title"), F.col("ordinal"))).alias("_next"))
    return after.select("view", ((F.col("_title") + F.coalesce("_next", F.col("_title") + 1)) / 2).alias("ordinal"))


def localized(text: Column, messages: dict[str, str], rules: list[tuple[str, str]] = ()) -> Column:
    """PR4: a message in another language: whole messages first, then rules in order, then parts; one of a thing loses its plural."""
    out = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)
    out = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), messages.items(), out)
    out = F.regexp_replace(out, r"(?<![0-9])1 (page|table|paragraph|main file)s\b", "1 $1")
    if not messages:
        return out
    table = F.create_map(*[F.lit(x) for m in messages.items() for x in m])
    return F.coalesce(F.try_element_at(table, text), out)


def localized_payload(rows: DataFrame, messages: dict[str, str], rules: list[tuple[str, str]] = ()) -> DataFrame:
    """PR4: rows whose texts in MESSAGE_FIELDS, at any depth of structs and arrays, are localized."""

    def change(c: Column, kind: T.DataType, field: str) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[change(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: change(x, kind.elementType, field))
        return localized(c, messages, rules) if isinstance(kind, T.StringType) and field in MESSAGE_FIELDS else c

    return rows.select(*[change(rows[f.name], f.dataType, f.name).alias(f.name) for f in rows.schema.fields])
