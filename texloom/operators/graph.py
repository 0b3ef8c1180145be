"""Include graphs: resolution, reachability and roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.plans.tables import cut, discard


BOUND = 100_000  # rounds after which a walk is taken for an endless one


def _walk(start: DataFrame, step) -> DataFrame:
    """All rows that step reaches from start, to the fixpoint; step takes the newest rows and the columns are the rows' key.

    A round writes the rows it finds, and joins the newest only; what is seen is all rounds' tables.
    """
    columns, read = start.columns, start.sparkSession.read
    new = cut(start.distinct())
    found = [new.cut_path]
    for _ in range(BOUND):
        seen = read.schema(new.schema).parquet(*found)
        new = cut(step(new).select(columns).distinct().join(seen, columns, "left_anti"))
        if new.isEmpty():
            discard(new)
            return seen
        found.append(new.cut_path)
    raise RuntimeError(f"the walk found new nodes after {BOUND} rounds")


def _climbed(ends: DataFrame, roots: DataFrame) -> DataFrame:
    """(project, node, up, opaque): for each node that one edge alone leads to, the nearest node above it that is not of that kind, or is a root.

    Pointers to the node above are doubled, so that a chain of any length takes as many rounds as its length has binary digits.
    opaque tells whether an edge on the way is.  Nodes on or below a ring of such nodes have none and are left out.
    """
    alone = ends.groupBy("project", "dst").agg(F.count("*").alias("n"), F.first("src").alias("up"), F.first("opaque").alias("opaque")).where("n = 1")
    inner = alone.select("project", F.col("dst").alias("node"), "up", "opaque").join(roots.select("project", "node").distinct(), ["project", "node"], "left_anti")
    above = inner.select("project", F.col("node").alias("up"), F.lit(True).alias("goes_on"))
    now = cut(inner.join(above, ["project", "up"], "left").select("project", "node", "up", "opaque", F.coalesce("goes_on", F.lit(False)).alias("goes_on")))
    # as long as a chain goes on, each round ends some of its nodes' ways; those of rings never end
    before = None
    while (left := now.where("goes_on").count()) and left != before:
        before = left
        next_up = now.select("project", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("opaque").alias("_opaque"), F.col("goes_on").alias("_goes_on"))
        moved = now.where("goes_on").join(next_up, ["project", "up"]).select("project", "node", F.col("_up").alias("up"), (F.col("opaque") | F.col("_opaque")).alias("opaque"), F.col("_goes_on").alias("goes_on"))
        last, now = now, cut(now.where("not goes_on").unionByName(moved))
        discard(last)
    return now.where("not goes_on").drop("goes_on")


def _states(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(project, node, opaque) states that edges (project, src, dst, opaque) hand on from roots, which are not opaque.

    Nodes that one edge alone leads to follow from what stands above them; only the others are walked to, from each other.
    """
    ends = edges.select("project", "src", "dst", F.coalesce("opaque", F.lit(False)).alias("opaque")).distinct()
    climbed = _climbed(ends, roots)
    met = ends.join(climbed.select("project", F.col("node").alias("dst")), ["project", "dst"], "left_anti")
    met = met.join(climbed.select("project", F.col("node").alias("src"), "up", F.col("opaque").alias("_above")), ["project", "src"], "left")
    on = cut(met.select("project", F.coalesce("up", "src").alias("node"), "dst", (F.col("opaque") | F.coalesce("_above", F.lit(False))).alias("_cut")).distinct())
    step = lambda new: new.join(on, ["project", "node"]).select("project", F.col("dst").alias("node"), (F.col("opaque") | F.col("_cut")).alias("opaque"))
    heads = _walk(roots.select("project", "node", F.lit(False).alias("opaque")), step)
    below = climbed.join(heads.select("project", F.col("node").alias("up"), F.col("opaque").alias("_from")), ["project", "up"]).select("project", "node", (F.col("opaque") | F.col("_from")).alias("opaque"))
    return heads.unionByName(below).distinct()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """GR1, ST2: (project, node) that edges (project, src, dst) reach from roots (project, node), whatever the depth."""
    plain = edges.select("project", "src", "dst", F.lit(False).alias("opaque"))
    return _states(plain, roots).select("project", "node")


def rooted_roles(edges: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first half of GR2: roles as the roots give them; nodes that no root reaches are open."""
    return _named_roles(_states(edges, roots), nodes)


def roles(edges: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR2: how each node is used: open, opaque or mixed.

    States are (node, opaque) pairs; an opaque include makes all below it opaque.  Then the
    nodes without a state are seeded as not opaque one by one, in their order, and each seed's
    states go on before the next is chosen: those that no smaller one of them reaches.
    """
    found = _states(edges, roots)
    left = nodes.select("project", "node").distinct().join(found, ["project", "node"], "left_anti")
    ends = edges.select("project", "src", "dst").distinct()
    inner = cut(ends.join(left.withColumnRenamed("node", "src"), ["project", "src"], "left_semi").join(left.withColumnRenamed("node", "dst"), ["project", "dst"], "left_semi"))
    least = new = cut(left.withColumn("least", F.col("node")))
    for _ in range(BOUND):
        step = new.join(inner.withColumnRenamed("src", "node"), ["project", "node"]).groupBy("project", F.col("dst").alias("node")).agg(F.min("least").alias("_least"))
        fresh = cut(step.join(least, ["project", "node"]).where("_least < least").select("project", "node", F.col("_least").alias("least")))
        if fresh.isEmpty():
            break
        lower = cut(least.unionByName(fresh).groupBy("project", "node").agg(F.min("least").alias("least")))
        discard(least, *([] if new is least else [new]))
        least, new = lower, fresh
    else:
        raise RuntimeError(f"the walk found new seeds after {BOUND} rounds")
    seeds = least.where("node = least").select("project", "node")
    return _named_roles(_states(edges, roots.select("project", "node").unionByName(seeds)), nodes)


def _named_roles(seen: DataFrame, nodes: DataFrame) -> DataFrame:
    role = F.when(F.bool_and("opaque"), "opaque").when(F.bool_or("opaque"), "mixed").otherwise("open")
    found = seen.groupBy("project", "node").agg(role.alias("role"))
    return nodes.select("project", "node").join(found, ["project", "node"], "left").select("project", "node", F.coalesce("role", F.lit("open")).alias("role"))


def resolve_includes(wanted: DataFrame, files: DataFrame, bases: tuple[str, ...] = ("main_dir", "file_dir", "root_dir")) -> DataFrame:
    """JN10: the first existing file of an include: bases in order, the name as it is before the name with .tex."""
    names = F.array(F.col("name"), F.when(~F.col("name").endswith(".tex"), F.concat("name", F.lit(".tex"))))
    tries = [F.struct(F.lit(i * 2 + j).alias("ord"), F.regexp_replace(F.concat_ws("/", F.nullif(F.col(b), F.lit("")), names[j]), r"^\./|/\./", "").alias("path")) for i, b in enumerate(bases) for j in (0, 1)]
    asked = wanted.withColumn("_try", F.explode(F.array(*tries))).where(F.col("_try.path").isNotNull())
    hit = asked.join(files.select(F.col("project").alias("_p"), F.col("path").alias("_f")), (F.col("project") == F.col("_p")) & (F.col("_try.path") == F.col("_f")))
    return hit.groupBy("project", "include_id").agg(F.min_by("_f", F.col("_try.ord")).alias("path"))


def asset_lookup(wanted: DataFrame, files: DataFrame, extensions: tuple[str, ...], folders: tuple[str, ...]) -> DataFrame:
    """JN13: the first existing asset, all folders for one extension before the next extension."""
    tries = [F.struct(F.lit(i * len(folders) + j).alias("ord"), F.concat(F.lit(d), F.col("name"), F.lit(e)).alias("path")) for i, e in enumerate(extensions) for j, d in enumerate(folders)]
    asked = wanted.withColumn("_try", F.explode(F.array(*tries)))
    hit = asked.join(files.select(F.col("path").alias("_f")), F.col("_try.path") == F.col("_f"))
    return hit.groupBy("asset_id").agg(F.min_by("_f", F.col("_try.ord")).alias("path"))


def missing_citations(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """JN14: cited keys without an entry, by section."""
    return cited.select("section", "key").distinct().join(entries.select("section", "key"), ["section", "key"], "left_anti").groupBy("section").agg(F.array_sort(F.collect_list("key")).alias("missing"))


def single_definitions(definitions: DataFrame) -> DataFrame:
    """AG5, AG7: names with one declaration keep their value; conflicting ones have none."""
    return definitions.groupBy("name").agg(F.count("*").alias("n"), F.when(F.min("value") == F.max("value"), F.min("value")).alias("value"))


def changed_keys(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """ST4: keys that were added, removed or changed."""
    a, b = before.select(key, F.col(value).alias("_a")), after.select(key, F.col(value).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def translation_files(reached: DataFrame, excluded: list[DataFrame]) -> DataFrame:
    """ST3: reached files without the excluded ones."""
    return reduce(lambda d, x: d.join(x.select("project", "node"), ["project", "node"], "left_anti"), excluded, reached)
