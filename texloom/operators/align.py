"""Alignment of two versions of a document: landmarks, chains and position mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.operators import chains as wide
from texloom.plans import intervals, ordered

GAP = 1e-7
BIN = 1 / 64  # of a page's height
CHARACTERS = 4096

# Weight of a landmark by the beginning of its name, first match first.
WEIGHTS = (
    (("page.", "Hfootnote.", "footnote."), 0),
    (("section", "subsection", "subsubsection", "chapter", "part", "appendix"), 12),
    (("table", "figure", "subfigure", "lstlisting"), 10),
    (("equation", "AMS"), 4),
    (("cite.",), 2),
)


def weight(name: Column) -> Column:
    """RK12: how much a landmark counts; 0 leaves it out."""
    out = F.when(name == "Doc-Start", 0)
    for starts, w in WEIGHTS:
        test = F.lit(False)
        for s in starts:
            test = test | name.startswith(s)
        out = out.when(test, w)
    return out.otherwise(3)


def page_ratio(width: Column, height: Column, rotation: Column) -> Column:
    """AR2: height of a page by its width, turned pages being swapped."""
    turned = F.pmod(rotation, F.lit(360)).isin(90, 270)
    return F.when(turned, width / height).otherwise(height / width)


def page_fraction(left: Column, bottom: Column, right: Column, top: Column, rotation: Column, x: Column, y: Column) -> Column:
    """AR2, SC12: how far down a page a destination is, between 0 and 1; NULL without a number for it."""
    turn = F.pmod(rotation, F.lit(360))
    width, height = F.nullif(right - left, F.lit(0.0)), F.nullif(top - bottom, F.lit(0.0))
    raw = F.when(turn == 90, (x - left) / width).when(turn == 180, (y - bottom) / height).when(turn == 270, 1 - (x - left) / width).otherwise((top - y) / height)
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def match_landmarks(landmarks: DataFrame) -> DataFrame:
    """JN1, ST1: landmarks of both sides by name, those that count and have both positions."""
    one = lambda side: landmarks.where((F.col("side") == side) & F.col("page").isNotNull() & F.col("fraction").isNotNull()).select("pair_id", "name", (F.col("page") + F.col("fraction")).alias(side))
    both = one("original").join(one("translated"), ["pair_id", "name"])
    return both.withColumn("weight", weight(F.col("name"))).where("weight > 0")


def landmark_order(pairs: DataFrame) -> DataFrame:
    """RK8: the place of each landmark of a pair of documents."""
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy("original", F.desc("weight"), "name")))


def heaviest_chain(x: list[float], y: list[float], w: list[float]) -> list[int]:
    """RK9: of points in order of x, the heaviest chain that rises in x and y by more than GAP; n log n steps.

    Ties go to the earliest predecessor and the earliest end.
    """
    score, before = wide.scores(x, y, w, list(range(len(x))), [wide.NONE] * len(x))
    at = max(range(len(x)), key=lambda i: (score[i], -i), default=None)
    out = []
    while at is not None:
        out.append(at)
        at = before[at]
    return out[::-1]


def chains(pairs: DataFrame, limit: int = wide.LIMIT) -> DataFrame:
    """RK9 for each pair of documents: in one task for pairs of up to limit landmarks, for larger ones on a grid of cells."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        name, x, y, w = (frame[c].tolist() for c in ("name", "original", "translated", "weight"))
        order = sorted(range(len(x)), key=lambda i: (x[i], -w[i], name[i]))
        kept = [order[i] for i in heaviest_chain(*([float(v[i]) for i in order] for v in (x, y, w)))]
        return pd.DataFrame({"pair_id": frame["pair_id"].iloc[0], "name": [name[i] for i in kept], "original": [x[i] for i in kept], "translated": [y[i] for i in kept], "weight": [w[i] for i in kept], "place": range(1, len(kept) + 1)})

    pairs = pairs.select("pair_id", "name", "original", "translated", "weight")
    many = pairs.groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("pair_id")
    shape = "pair_id long, name string, original double, translated double, weight int, place int"
    if not many.head(1):
        return pairs.groupBy("pair_id").applyInPandas(one, shape)
    small = pairs.join(many, "pair_id", "left_anti").groupBy("pair_id").applyInPandas(one, shape)
    return small.unionByName(wide.wide_chains(pairs.join(many, "pair_id", "left_semi"), limit))


def page_starts(heights: DataFrame) -> DataFrame:
    """RK10: where each page starts on its document's common axis; a document's pages may reach over many parts."""
    rows = ordered.dealt(heights, ["pair_id", "side"], ["page"])
    return ordered.running(rows.withColumn("_ratio", F.col("ratio").cast("double")), ["pair_id", "side"], {"_ratio": "start"}).select(*heights.columns, F.col("start").cast("double").alias("start"))


def rising(pairs: DataFrame) -> DataFrame:
    """RK11: whether the landmarks of a pair rise strictly on both sides; a pair's landmarks may reach over many parts."""
    step = ordered.neighbour(ordered.dealt(pairs, ["pair_id"], ["place"]), ["pair_id"], {"original": "_o", "translated": "_t"})
    good = F.coalesce((F.col("original") > F.col("_o")) & (F.col("translated") > F.col("_t")), F.lit(True))
    return step.groupBy("pair_id").agg(F.bool_and(good).alias("ordered"))


def _document(heights: DataFrame, side: str) -> DataFrame:
    """(pair_id, edges, ratios, end): where the pages of one side start, in order; a document's pages are one bounded array."""
    pages = heights.where(F.col("side") == side).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("page", F.col("ratio").cast("double").alias("ratio")))).alias("p"))
    ratios = F.transform("p", lambda p: p["ratio"])
    edges = F.aggregate(ratios, F.array(F.lit(0.0)), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r)))
    return pages.select("pair_id", edges.alias("edges"), ratios.alias("ratios")).withColumn("end", F.element_at("edges", -1))


def _clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, value))


def coordinate(page: Column, fraction: Column, edges: Column, ratios: Column) -> Column:
    """AR4: a position on its document's common axis; pages and fractions outside are taken to the nearest."""
    i = _clamp(page, 1, F.size(ratios)).cast("int")
    return F.element_at(edges, i) + _clamp(fraction, 0.0, 1.0) * F.element_at(ratios, i)


def locate(value: Column, edges: Column, ratios: Column) -> Column:
    """AR4: the page (from 1) and the fraction in it of a place on a document's axis."""
    i = F.greatest(F.lit(1), F.least(F.size(ratios), F.size(F.filter(edges, lambda e: e <= value))))
    return F.struct(i.alias("page"), _clamp((value - F.element_at(edges, i)) / F.element_at(ratios, i), 0.0, 1.0).alias("fraction"))


def map_positions(queries: DataFrame, landmarks: DataFrame, heights: DataFrame) -> DataFrame:
    """JN6, PL3: (pair_id, query_id, page, fraction) of positions in the translated document.

    queries (pair_id, query_id, page, fraction) are places in the original, landmarks
    (pair_id, original, translated) places on both axes, heights (pair_id, side, page, ratio).
    (0, 0) and (end, end) are landmarks too, those on or outside a boundary are none; between
    two, places are interpolated.  A pair of documents without a landmark, or whose landmarks
    don't rise strictly on both sides, keeps page and fraction, clamped to the pages there are.
    Landmarks and questions are stacked and sorted over all tasks, and last and first values carry the
    brackets, in the parts and between them; there is no product of the two sides.
    """
    ends = _document(heights, "original").select("pair_id", F.col("edges").alias("oe"), F.col("ratios").alias("orr"), F.col("end").alias("o_end"))
    ends = ends.join(_document(heights, "translated").select("pair_id", F.col("edges").alias("te"), F.col("ratios").alias("tr"), F.col("end").alias("t_end")), "pair_id")
    given = landmarks.select("pair_id", F.col("original").cast("double").alias("o"), F.col("translated").cast("double").alias("t"))
    some = given.groupBy("pair_id").agg(F.count("*").alias("n"))
    inner = given.join(ends.select("pair_id", "o_end", "t_end"), "pair_id").where("o > 0 and t > 0 and o < o_end and t < t_end").select("pair_id", "o", "t")
    bounds = ends.select("pair_id", F.explode(F.array(F.struct(F.lit(0.0).alias("o"), F.lit(0.0).alias("t")), F.struct(F.col("o_end").alias("o"), F.col("t_end").alias("t")))).alias("b")).select("pair_id", "b.o", "b.t")
    marks = inner.unionByName(bounds)
    # the order is that of the originals; equal ones, and translations that don't rise, break it
    step = ordered.neighbour(ordered.dealt(marks, ["pair_id"], ["o", "t"]), ["pair_id"], {"o": "_o", "t": "_t"})
    good = step.groupBy("pair_id").agg(F.bool_and(F.coalesce((F.col("o") > F.col("_o")) & (F.col("t") > F.col("_t")), F.lit(True))).alias("good"))
    known = ends.join(good, "pair_id").join(some, "pair_id", "left").withColumn("good", F.col("good") & F.col("n").isNotNull()).drop("n")
    asked = queries.select("pair_id", "query_id", "page", F.col("fraction").cast("double").alias("fraction")).join(known, "pair_id")
    page_local = F.struct(_clamp(F.col("page"), 1, F.size("tr")).cast("int").alias("page"), _clamp(F.col("fraction"), 0.0, 1.0).alias("fraction"))
    value = coordinate(F.col("page"), F.col("fraction"), F.col("oe"), F.col("orr"))
    local = asked.where(~F.col("good")).select("pair_id", "query_id", page_local.alias("p"))
    places = asked.where("good").select("pair_id", "query_id", value.alias("at"))
    points = marks.select("pair_id", F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("o").alias("at"), F.struct("o", "t").alias("mark"), F.lit(0).alias("kind"))
    rows = points.unionByName(places.select("*", F.lit(None).cast("struct<o:double,t:double>").alias("mark"), F.lit(1).alias("kind")))
    between = ordered.surrounding(ordered.dealt(rows, ["pair_id"], ["at", "kind", "query_id"]), ["pair_id"], "mark", "_low", "_high").where("kind = 1")
    ratio = _clamp((F.col("at") - F.col("_low.o")) / (F.col("_high.o") - F.col("_low.o")), 0.0, 1.0)
    # the end itself has no mark above it
    mapped = F.when(F.col("_high").isNull(), F.col("_low.t")).otherwise(F.col("_low.t") + ratio * (F.col("_high.t") - F.col("_low.t")))
    found = between.select("pair_id", "query_id", mapped.alias("v")).join(ends.select("pair_id", "te", "tr"), "pair_id").select("pair_id", "query_id", locate(F.col("v"), F.col("te"), F.col("tr")).alias("p"))
    return found.unionByName(local).select("pair_id", "query_id", "p.page", "p.fraction")


def in_one_region(positions: DataFrame, regions: DataFrame) -> DataFrame:
    """JN5: positions that lie in exactly one figure region, mapped within it.

    No position meets a region: beginnings, positions and ends are sorted over all tasks, and the number of regions that are
    open at a position is a running sum, as is, by bitwise differences, the number of the only one.
    """
    r = regions.where("source_end > source_start and target_end > target_start").select("pair_id", "source_page", "source_start", "source_end", "target_page", "target_start", "target_end")
    r = ordered.dealt(r, ["pair_id", "source_page"], ["source_start", "source_end", "target_page", "target_start", "target_end"])
    r = r.withColumn("_id", F.shiftleft(F.col(ordered.PART).cast("long"), 33).bitwiseOR(F.col(ordered.PLACE)) + 1).drop(ordered.PART, ordered.PLACE)
    none = F.lit(None).cast(positions.schema["position_id"].dataType)
    edge = lambda at, kind, step: r.select("pair_id", F.col("source_page").alias("page"), F.col(at).cast("double").alias("_at"), F.lit(kind).alias("_kind"), F.lit(step).alias("_step"), "_id", none.alias("position_id"))
    asked = positions.select("pair_id", "page", F.col("fraction").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_step"), F.lit(0).cast("long").alias("_id"), "position_id")
    rows = edge("source_start", 0, 1).union(asked).union(edge("source_end", 2, -1)).where("_at is not null")
    swept = ordered.running(ordered.dealt(rows, ["pair_id", "page"], ["_at", "_kind", "_id"]), ["pair_id", "page"], {"_step": "_open"}, {"_id": "_which"})
    one = swept.where("_kind = 1 and _open = 1").select("position_id", F.col("_at").alias("fraction"), F.col("_which").alias("_id")).join(r, "_id")
    ratio = (F.col("fraction") - F.col("source_start")) / (F.col("source_end") - F.col("source_start"))
    return one.select("position_id", F.col("target_page").alias("page"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("target_start") + ratio * (F.col("target_end") - F.col("target_start")))).alias("fraction"))


def match_regions(captions: DataFrame, regions: DataFrame, reach: float = 0.065) -> DataFrame:
    """JN2: of the regions near a caption on both sides, the pair of equal signature, if it is the only one.

    Captions of one place are one row, as are like regions, with their numbers; they meet in the bins of
    their page that both touch, so only near ones do.  A caption that occurs twice has each pair twice.
    """
    place = ["pair_id", "original_page", "translated_page", "original_fraction", "translated_fraction"]
    alike = regions.groupBy("pair_id", "side", "page", "signature", "start", "end").agg(F.count("*").alias("_n"))
    side = lambda s, page: alike.where(F.col("side") == s).select("pair_id", F.col("page").alias(page), F.col("signature").alias(f"_{s}"), F.col("_n").alias(f"_of_{s}"), (F.col("start") - reach).alias(f"_{s}_low"), (F.col("end") + reach).alias(f"_{s}_high"))
    out = captions.select(*place).distinct()
    for s in ("original", "translated"):
        page, fraction = f"{s}_page", f"{s}_fraction"
        out = out.withColumn("_at", F.col(fraction))
        out = intervals.overlapping(out, side(s, page), ["pair_id", page], ("_at", fraction), (f"_{s}_low", f"_{s}_high"), BIN).drop("_at", f"_{s}_low", f"_{s}_high")
        # regions of one signature near one place are one row from here on
        out = out.groupBy(*[c for c in out.columns if c != f"_of_{s}"]).agg(F.sum(f"_of_{s}").alias(f"_n_{s}"))
    both = out.where("_original = _translated").groupBy(*place).agg(F.sum(F.col("_n_original") * F.col("_n_translated")).alias("_n"), F.first("_original").alias("signature"))
    found = captions.select("name", *place).join(both, place)
    return found.groupBy("pair_id", "name").agg(F.sum("_n").alias("n"), F.first("signature").alias("signature")).where("n = 1").drop("n")


def slices_of_matches(items: DataFrame, matches: DataFrame) -> DataFrame:
    """JN8: the parts of text items that matches cover, items being laid end to end on a page; empty items and matches have none.

    Items are laid out by a scan over all tasks, and meet matches in the bins of the page's characters.
    """
    rows = ordered.dealt(items.select("page", "ord", "length"), ["page"], ["ord"])
    placed = ordered.running(rows, ["page"], {"length": "at"}).where("length > 0").select("page", "ord", "at", (F.col("at") + F.col("length") - 1).alias("_last"))
    asked = matches.where("size > 0").select("page", "match_id", "start", (F.col("start") + F.col("size") - 1).alias("_end"))
    j = intervals.overlapping(placed, asked, ["page"], ("at", "_last"), ("start", "_end"), CHARACTERS)
    lo, hi = F.greatest(F.col("start"), F.col("at")), F.least(F.col("_end"), F.col("_last")) + 1
    return j.select("page", "match_id", "ord", (lo - F.col("at")).alias("from"), (hi - F.col("at")).alias("to"))


def greedy_batches(rows: Iterator[tuple[int, int]], most: int = 50, size: int = 128 * 1024) -> Iterator[tuple[int, int]]:
    """RK14: (row, batch): a batch closes before it holds more than most texts or size bytes."""
    batch, count, total = 0, 0, 0
    for row, n in rows:
        if count and (count >= most or total + n > size):
            batch, count, total = batch + 1, 0, 0
        count, total = count + 1, total + n
        yield row, batch


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a sorted stream, each whole, whatever batches it comes in."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        codes = np.stack([pd.factorize(frame[c])[0] for c in by])  # nulls are one code
        new = np.concatenate(([True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)))
        if held:
            last = held[-1][by].iloc[-1]
            new[0] = any(not (a == b or (pd.isna(a) and pd.isna(b))) for a, b in zip(last, frame[by].iloc[0]))
        starts = [*new.nonzero()[0].tolist(), len(frame)]
        if starts[0] > 0:
            held.append(frame.iloc[: starts[0]])
        for a, b in zip(starts, starts[1:]):
            if held:
                yield pd.concat(held)
            held = [frame.iloc[a:b]]
    if held:
        yield pd.concat(held)


def _jumps(sizes: np.ndarray, rows: int, most: int, size: int) -> np.ndarray:
    """Where the batch that starts at each of the first rows ends."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(rows)
    fit = np.searchsorted(total, total[at] + size, side="right") - 1
    return np.minimum(np.maximum(fit, at + 1), np.minimum(at + most, len(sizes)))


def batches(texts: DataFrame, key: str, most: int = 50, size: int = 128 * 1024, block: int = 4096) -> DataFrame:
    """RK14 within each key, in order of ord, for keys of any size.

    A batch that starts at a row ends where the prefix sums of sizes say, at most ``most`` rows on.  So a block of
    rows is entered at one of its first ``most`` rows, and is a function from there to the row at which
    the next block is entered.  All blocks make their functions at once; a stream over a key's blocks,
    a few hundred numbers each, follows them, and all blocks are walked from their entry at once.
    Blocks see the ``most`` rows that follow them.  Null keys are a key; null texts have no bytes.
    """
    kind = texts.schema[key].dataType.simpleString()
    sizes = texts.select(F.col(key).alias("_key"), F.col("ord").cast("long").alias("ord"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("_one"))
    block = max(block, most + 1)
    rank = ordered.running(ordered.dealt(sizes, ["_key"], ["ord"]), ["_key"], {"_one": "_rank"})
    home = F.floor(F.col("_rank") / block).cast("long")
    seen = F.when((F.col("_rank") % block < most) & (F.col("_rank") >= block), F.array(home, home - 1)).otherwise(F.array(home))
    rows = rank.select("_key", "ord", "n_bytes", "_rank", F.explode(seen).alias("_block"))
    streamed = rows.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_rank")

    def functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in _groups(frames, ["_key", "_block"]):
            own = min(block, len(g))
            ends = _jumps(g["n_bytes"].to_numpy(), own, most, size)
            exits, counts = np.zeros(own, np.int64), np.zeros(own, np.int64)
            for i in range(own - 1, -1, -1):
                j = ends[i]
                exits[i], counts[i] = (j - block, 1) if j >= own else (exits[j], counts[j] + 1)
            out.append((g["_key"].iloc[0], g["_block"].iloc[0], exits[:most].tolist(), counts[:most].tolist()))
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=["_key", "_block", "exits", "counts"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["_key", "_block", "exits", "counts"])

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, entry, before = object(), 0, 0
        for frame in frames:
            out = []
            for k, b, exits, counts in zip(frame["_key"].tolist(), frame["_block"].tolist(), frame["exits"], frame["counts"]):
                if b == 0:
                    key, entry, before = k, 0, 0
                out.append((k, b, entry, before))
                if entry < len(exits):  # the last block may be shorter than its entry
                    entry, before = int(exits[entry]), before + int(counts[entry])
            yield pd.DataFrame(out, columns=["_key", "_block", "entry", "before"])

    made = streamed.select("_key", "_block", "n_bytes").mapInPandas(functions, f"_key {kind}, _block long, exits array<bigint>, counts array<bigint>")
    found = made.repartition("_key").sortWithinPartitions("_key", "_block").mapInPandas(entries, f"_key {kind}, _block long, entry long, before long")
    own = rank.select("_key", "ord", "n_bytes", "_rank", home.alias("_block")).alias("l").join(found.alias("r"), F.expr("l._key <=> r._key and l._block = r._block")).select("l.*", "r.entry", "r.before")

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(frames, ["_key", "_block"]):
            n, at = len(g), int(g["entry"].iloc[0])
            ends = _jumps(g["n_bytes"].to_numpy(), n, most, size)
            opened = np.zeros(n, np.int64)
            while at < n:
                opened[at] = 1
                at = int(ends[at])
            yield pd.DataFrame({"_key": g["_key"], "ord": g["ord"], "batch": g["before"] + np.cumsum(opened) - 1})

    out = own.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_rank").mapInPandas(walked, f"_key {kind}, ord long, batch long")
    return out.withColumnRenamed("_key", key)
