"""RK9 for pairs of any size: the heaviest rising chain on a grid of cells.

The landmarks of a pair are cut into strips of x and ranges of y, of about ``limit`` landmarks each, so that
landmarks of different strips are more than GAP apart.  What stands before a landmark of cell (a, b) is
in the cell itself, in earlier strips of range b, in lower ranges of strip a, or in cells that are
earlier in both, all of which count.  So a cell takes three things from others: the best scores of range b as they
rise with y, those of strip a as they rise with x, and one best score of all cells earlier in both.  Cells with
the same a + b are scored at once, one round after the other; lists that no later cell asks for stop
where they are.  The chain is then followed from its end through the cells, one point
a cell, and all its cells are walked at once.

A task holds one cell and the two lists that reach it, a few times ``limit`` rows at most, unless more
landmarks than that lie within GAP of their neighbours on one axis.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.plans import ordered
from texloom.plans.tables import cut

GAP = 1e-7
LIMIT = 200_000
POINT, ROW_LIST, COLUMN_LIST, ROW_BEST, COLUMN_BEST, CORNER = range(6)
CELL = "pair_id long, a long, b long, kind int, x double, y double, score double, pos long, before long, out long"
Best = tuple[float, int]  # (score, -place): ties go to the earliest place
NONE: Best = (0.0, 1)


def scores(x: list[float], y: list[float], w: list[float], pos: list[int], given: list[Best]) -> tuple[list[float], list[int | None]]:
    """For points in order of x and of their places: the score of the heaviest chain that ends at each, and the point of the same list before it.

    given are the best chains from elsewhere; the point before is None where one of those, or nothing, is.
    """
    ranks = sorted(set(y))
    place = {v: i for i, v in enumerate(ranks)}
    number = {p: i for i, p in enumerate(pos)}
    tree: list[Best] = [NONE] * (len(ranks) + 1)
    score, before, waiting = [0.0] * len(x), [None] * len(x), 0
    low = np.searchsorted(ranks, np.asarray(y) - GAP, side="left").tolist()
    for i in range(len(x)):
        while x[waiting] < x[i] - GAP:
            entry, at = (score[waiting], -pos[waiting]), place[y[waiting]] + 1
            while at <= len(ranks):
                tree[at] = max(tree[at], entry)
                at += at & -at
            waiting += 1
        best, at = NONE, low[i]
        while at > 0:
            best = max(best, tree[at])
            at -= at & -at
        if best > given[i]:
            before[i] = number[-best[1]]
        score[i] = max(best[0], given[i][0]) + w[i]
    return score, before


def _rising(frame: pd.DataFrame, axis: str) -> pd.DataFrame:
    """The rows that a greater place on the axis alone would not make worse than another: (axis, score, -pos) rise together."""
    frame = frame.sort_values([axis, "score", "pos"], ascending=[True, False, True], kind="stable")
    if not len(frame):
        return frame
    order = np.lexsort((-frame["pos"].to_numpy(), frame["score"].to_numpy()))
    rank = np.empty(len(frame), np.int64)
    rank[order] = np.arange(len(frame))
    top = np.maximum.accumulate(rank)
    return frame[np.concatenate(([True], top[1:] > top[:-1]))]


def _under(rising: pd.DataFrame, axis: str, values: np.ndarray) -> list[Best]:
    at = np.searchsorted(rising[axis].to_numpy(), values - GAP, side="left") - 1
    score, pos = rising["score"].to_numpy(), rising["pos"].to_numpy()
    return [(float(score[i]), -int(pos[i])) if i >= 0 else NONE for i in at.tolist()]


def _cell(group: pd.DataFrame) -> pd.DataFrame:
    pair, a, b = (int(group[c].iloc[0]) for c in ("pair_id", "a", "b"))
    of = lambda kind: group[group["kind"] == kind]
    points = of(POINT).sort_values("pos").reset_index(drop=True)
    rows, columns = _rising(of(ROW_LIST), "y"), _rising(of(COLUMN_LIST), "x")
    best = lambda f: max(((s, -p) for s, p in zip(f["score"].tolist(), f["pos"].tolist())), default=NONE)
    corner, row_best, column_best = best(of(CORNER)), best(of(ROW_BEST)), best(of(COLUMN_BEST))
    given = [max(corner, r, c) for r, c in zip(_under(rows, "y", points["y"].to_numpy()), _under(columns, "x", points["x"].to_numpy()))]
    weight, pos = points["score"].tolist(), points["pos"].tolist()
    score, inside = scores(points["x"].tolist(), points["y"].tolist(), weight, pos, given)
    before = [pos[j] if j is not None else (-g[1] if g[0] > 0 else -1) for j, g in zip(inside, given)]
    out: list[int] = []
    for j, p in zip(inside, before):
        out.append(p if j is None else out[j])  # the point of another cell that the chain comes from
    points = points.assign(score=score, before=before, out=out)
    own = best(points)
    row_best, column_best = max(row_best, own), max(column_best, own)
    parts = [points]
    # a landmark of this cell may tie in y with one of the list; the better stays
    for kind, frame, axis, (da, db) in ((ROW_LIST, rows, "y", (1, 0)), (COLUMN_LIST, columns, "x", (0, 1))):
        parts.append(_rising(pd.concat([frame, points]), axis).assign(kind=kind, a=a + da, b=b + db))
    for kind, value, (da, db) in ((ROW_BEST, row_best, (1, 0)), (COLUMN_BEST, column_best, (0, 1)), (CORNER, max(corner, row_best, column_best), (1, 1))):
        if value[0] > 0:
            parts.append(pd.DataFrame({"pair_id": [pair], "a": [a + da], "b": [b + db], "kind": [kind], "x": [0.0], "y": [0.0], "score": [value[0]], "pos": [-value[1]]}))
    found = pd.concat(parts)
    return found.assign(before=found["before"].fillna(-1), out=found["out"].fillna(-1)).astype({"pos": "int64", "before": "int64", "out": "int64", "kind": "int32"})[[c.split()[0] for c in CELL.split(", ")]]


def _strips(rows: DataFrame, axis: str, name: str, limit: int) -> DataFrame:
    """Dealt rows, sorted by axis, with the number of their strip; a strip begins behind a step of more than GAP."""
    known = rows.columns
    stepped = ordered.neighbour(rows.withColumn("_one", F.lit(1).cast("long")), ["pair_id"], {axis: "_was"})
    counted = ordered.running(stepped, ["pair_id"], {"_one": "_rank"})
    began = counted.withColumn("_start", F.when(F.col("_was").isNull() | (F.col(axis) - F.col("_was") > GAP), F.col("_rank")))
    led = ordered.surrounding(began, ["pair_id"], "_start", "_led", "_next")
    return led.select(*known, F.col("_rank").alias(f"_rank_{name}"), F.floor(F.col("_led") / limit).cast("long").alias(name))


def wide_chains(pairs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(pair_id, name, original, translated, weight, place) of the heaviest chain of each pair."""
    first = ordered.dealt(pairs.withColumn("_down", -F.col("weight")), ["pair_id"], ["original", "_down", "name"])
    by_x = _strips(first, "original", "a", limit).drop(ordered.PART, ordered.PLACE).withColumnRenamed("_rank_a", "pos")
    second = ordered.dealt(by_x, ["pair_id"], ["translated"])
    grid = _strips(second, "translated", "b", limit)
    rows = cut(grid.select("pair_id", "name", "original", "translated", "weight", "pos", "a", "b", (F.col("a") + F.col("b")).alias("_round")).repartitionByRange(ordered.partitions(pairs), "_round", "pair_id", "a"), "chain-cells")
    last_a = rows.groupBy("pair_id", "b").agg(F.max("a").alias("_last"))
    last_b = rows.groupBy("pair_id", "a").agg(F.max("b").alias("_last"))
    rounds = rows.agg(F.max("_round")).first()[0]
    names = [c.split()[0] for c in CELL.split(", ")]
    blank = [F.lit(-1).cast("long").alias(c) for c in ("before", "out")]
    made: list[DataFrame] = []
    for r in range(0 if rounds is None else rounds + 1):
        points = rows.where(F.col("_round") == r).select("pair_id", "a", "b", F.lit(POINT).alias("kind"), F.col("original").alias("x"), F.col("translated").alias("y"), F.col("weight").cast("double").alias("score"), "pos", *blank)
        inbox = [points]
        if made:
            sent = made[-1].where(F.col("kind") != CORNER)
            listed = sent.where(F.col("kind") == ROW_LIST).join(last_a, ["pair_id", "b"]).where("a <= _last").select(*names)
            stacked = sent.where(F.col("kind") == COLUMN_LIST).join(last_b, ["pair_id", "a"]).where("b <= _last").select(*names)
            inbox += [listed, stacked, sent.where(F.col("kind").isin(ROW_BEST, COLUMN_BEST))]
        inbox += [m.where(F.col("kind") == CORNER) for m in made[-2:-1]]
        made.append(cut(reduce(DataFrame.union, inbox).groupBy("pair_id", "a", "b").applyInPandas(_cell, CELL), "chain-round"))
    if not made:
        return rows.select("pair_id", "name", "original", "translated", "weight", F.lit(1).alias("place")).limit(0)
    scored = [m.where(F.col("kind") == POINT) for m in made]
    # from the end of each chain back, a round at a time: the point at which it enters each cell from above
    ends = reduce(DataFrame.union, [s.groupBy("pair_id").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"), F.max("score").alias("score")) for s in scored])
    at = cut(ends.groupBy("pair_id").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos")), "chain-ends")
    entered = []
    for s in reversed(scored):
        hit = at.join(s.select("pair_id", "pos", "a", "b", "out"), ["pair_id", "pos"], "left")
        now = cut(hit, "chain-entries")
        entered.append(now.where("a is not null").select("pair_id", "a", "b", "pos"))
        at = now.where("a is null or out >= 0").select("pair_id", F.when(F.col("a").isNull(), F.col("pos")).otherwise(F.col("out")).alias("pos"))
    entries = reduce(DataFrame.union, entered).withColumnRenamed("pos", "entry")
    cells = reduce(DataFrame.union, scored).join(entries, ["pair_id", "a", "b"])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        before = dict(zip(group["pos"].tolist(), group["before"].tolist()))
        at, kept = int(group["entry"].iloc[0]), []
        while at in before:
            kept.append(at)
            at = before[at]
        return pd.DataFrame({"pair_id": group["pair_id"].iloc[0], "pos": kept})

    kept = cells.groupBy("pair_id", "a", "b").applyInPandas(walk, "pair_id long, pos long")
    chain = rows.join(kept, ["pair_id", "pos"]).select("pair_id", "name", "original", "translated", "weight", "pos", F.lit(1).cast("long").alias("_one"))
    placed = ordered.running(ordered.dealt(chain, ["pair_id"], ["pos"]), ["pair_id"], {"_one": "_n"})
    return placed.select("pair_id", "name", "original", "translated", "weight", (F.col("_n") + 1).cast("int").alias("place"))
