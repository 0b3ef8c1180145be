"""Where figures stand on pages, from tables of drawing operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions.records import matrix_product
from texloom.operators.align import page_fraction
from texloom.plans.ordered import partitions
from texloom.plans.tables import cut

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
LEAST_WIDTH, LEAST_HEIGHT = 0.1, 0.04
MATRIX = "array<double>"


def product(first: tuple, second: tuple) -> tuple:
    """AR5: the matrix that applies first, then second."""
    a, b, c, d, e, f = first
    g, h, i, j, k, m = second
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m)


class Effect:
    """What a stretch of operations does to the frames it finds: the current matrix and, below it, the saved ones.

    It takes away ``pops`` of them; ``frames``, from the lowest to the current one, are
    relative to the one that is on top then.  Below the lowest frame of a page there are
    identities without end, so a restore that has nothing saved gives the identity.
    Effects of neighbouring stretches combine to that of both, in any grouping.
    """

    def __init__(self, pops: int = 0, frames: list[tuple] | None = None):
        self.pops, self.frames = pops, frames or [IDENTITY]

    def save(self) -> None:
        self.frames.append(self.frames[-1])

    def restore(self) -> None:
        if len(self.frames) > 1:
            self.frames.pop()
        else:
            self.pops, self.frames = self.pops + 1, [IDENTITY]

    def move(self, matrix: tuple) -> None:
        self.frames[-1] = product(matrix, self.frames[-1])

    def then(self, other: Effect) -> Effect:
        kept = len(self.frames) - 1 - other.pops
        if kept < 0:
            return Effect(self.pops - kept, list(other.frames))
        return Effect(self.pops, self.frames[:kept] + [product(f, self.frames[kept]) for f in other.frames])

    def below(self, n: int) -> tuple:
        """The frame that n restores after this effect, from a page's start, would give."""
        return self.frames[-1 - n] if n < len(self.frames) else IDENTITY


PLACED = f"page_id long, part int, ord long, name string, pops int, frames array<{MATRIX}>"


def _effects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each painted object, with its matrix relative to the part's start, and one (ord null) for the effect of the part on the page."""
    part, page, effect = TaskContext.get().partitionId(), None, None
    columns = ["page_id", "part", "ord", "name", "pops", "frames"]
    whole = lambda: (page, part, None, None, effect.pops, [list(f) for f in effect.frames])
    for frame in frames:
        out = []
        for page_id, order, op, args, name in zip(frame["page_id"].tolist(), frame["ord"].tolist(), frame["op"].tolist(), frame["args"], frame["name"].tolist()):
            if effect is None or page_id != page:
                if effect is not None:
                    out.append(whole())
                page, effect = page_id, Effect()
            if op == "q":
                effect.save()
            elif op == "Q":
                effect.restore()
            elif op == "cm" and args is not None and len(args) == 6:
                effect.move(tuple(map(float, args)))
            elif op == "Do" and name is not None:
                out.append((page, part, order, name, effect.pops, [list(effect.frames[-1])]))
        yield pd.DataFrame(out, columns=columns).astype({"ord": "Int64"})
    if effect is not None:
        yield pd.DataFrame([whole()], columns=columns).astype({"ord": "Int64"})


def _entries(blocks: pd.DataFrame) -> pd.DataFrame:
    """The frames, current one first, that each part of a page finds."""
    out, so_far = [], Effect()
    for _, row in blocks.sort_values("part").iterrows():
        out.append((row["page_id"], row["part"], [list(f) for f in reversed(so_far.frames)]))
        so_far = so_far.then(Effect(int(row["pops"]), [tuple(f) for f in row["frames"]]))
    return pd.DataFrame(out, columns=["page_id", "part", "found"])


def painted(operations: DataFrame) -> DataFrame:
    """SC13: (page_id, ord, name, matrix) of the objects that operations (page_id, ord, op, args, name) paint.

    q saves the matrix, Q restores it (the identity, where none is saved), cm with six numbers
    goes before it, Do paints a name; other operations and nulls change nothing.  Operations are sorted over
    all tasks, so that a page may reach over many parts; each is read once as a stream, and only the
    effects of the parts of such pages, at most two a part, are put together, in their order.
    Operations without a page are left out; those of one page and ord stand by op.
    """
    rows = operations.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("ord").cast("long").alias("ord"), "op", F.col("args").cast(MATRIX).alias("args"), "name")
    local = cut(rows.repartitionByRange(partitions(rows), "page_id", "ord", "op").sortWithinPartitions("page_id", "ord", "op").mapInPandas(_effects, PLACED), "painted")
    blocks = local.where("ord is null").select("page_id", "part", "pops", "frames")
    many = blocks.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id")
    entries = blocks.join(many, "page_id").groupBy("page_id").applyInPandas(_entries, f"page_id long, part int, found array<{MATRIX}>")
    objects = local.where("ord is not null").join(entries, ["page_id", "part"], "left")
    start = F.coalesce(F.get("found", F.col("pops")), F.array(*[F.lit(x) for x in IDENTITY]))
    return objects.select("page_id", "ord", "name", matrix_product(F.get("frames", F.lit(0)), start).alias("matrix"))


def graphic_regions(operations: DataFrame, objects: DataFrame, pages: DataFrame) -> DataFrame:
    """SC13: (page_id, ord, signature, start, end): from which to which fraction of its page a figure reaches.

    objects (page_id, name, subtype, bounds, matrix, signature) are forms and images, without bounds the unit square,
    pages (page_id, left, bottom, right, top, rotation) the boxes.  Figures narrower than a tenth or lower than a
    twenty-fifth of the page, outside it or without a signature are none.  An object's name is one row's of its page.
    """
    kept = objects.where("subtype in ('/Form', '/Image') and signature is not null").select(
        "page_id", "name", "signature", F.coalesce(F.col("bounds").cast(MATRIX), F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)])).alias("b"), F.coalesce(F.col("matrix").cast(MATRIX), F.array(*[F.lit(x) for x in IDENTITY])).alias("own")
    )
    d = painted(operations).join(kept, ["page_id", "name"]).join(pages, "page_id")

    def box(m: Column) -> Column:
        """The least upright box around the object: each coordinate is a sum of one term of x and one of y."""
        ends = lambda i: [F.get(m, F.lit(i)) * F.get("b", F.lit(k)) for k in (0, 2)]
        tops = lambda i: [F.get(m, F.lit(i)) * F.get("b", F.lit(k)) for k in (1, 3)]
        edge = lambda pick, n: F.get(m, F.lit(4 + n)) + pick(*ends(n)) + pick(*tops(2 + n))
        return F.struct(edge(F.least, 0).alias("x0"), edge(F.greatest, 0).alias("x1"), edge(F.least, 1).alias("y0"), edge(F.greatest, 1).alias("y1"))

    def reach(g: Column) -> Column:
        sides = [page_fraction(F.col("left"), F.col("bottom"), F.col("right"), F.col("top"), F.col("rotation"), g[x], g[y]) for x, y in (("x0", "y0"), ("x1", "y1"))]
        large = ((g["x1"] - g["x0"]) / (F.col("right") - F.col("left")) >= LEAST_WIDTH) & ((g["y1"] - g["y0"]) / (F.col("top") - F.col("bottom")) >= LEAST_HEIGHT)
        return F.when(large, F.struct(F.least(*sides).alias("start"), F.greatest(*sides).alias("end")))

    # values are bound one by one, as an expression that names a matrix often would repeat its product each time
    let = lambda value, body: F.transform(F.array(value), body)[0]
    found = d.select("page_id", "ord", "signature", let(let(matrix_product(F.col("own"), F.col("matrix")), box), reach).alias("at"))
    return found.where("at.end > at.start").select("page_id", "ord", "signature", "at.start", "at.end")
