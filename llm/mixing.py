"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks of rows.  With integer weights that sum to W, block k
of a source of weight a is released at slot ``floor((k - 1) W / a)`` and due by slot
``ceil(k W / a)``.  Earliest deadline first among the released blocks meets every
deadline, so after any t slots a source has had less than one block more or less than
``t a / W``.  Windows repeat with period W: one period is scheduled from the weights
alone, and a block's slot follows from its number by arithmetic.  No row is compared
with rows of another source, and nothing that grows with the data is broadcast.

Block numbers need a rank within the source, where one source may hold a third of all
rows.  Rows are ranked by a hash of their id within (source, leading digits of the
hash), and the counts of the smaller digits are added: at most DIGITS**16 sums for each
weight, which is the bound of the broadcast table.

A source keeps its weight until it runs out; its later slots stay empty, and the
others keep their order.  No row is dropped or repeated.

Defined results.  Null sources and sources without a weight share the stream OTHER,
whose weight is ``other``.  A null doc_id is hashed as an empty text.  Repeated rows
take a place each.  Other columns are returned as they are by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "(other)"
DIGITS = 3
BLOCK_ROWS = 16
SEED = "mix-1:"
WEIGHTS = {f"src{i}": 2 + i % 4 for i in range(20)}


def integer_weights(targets: dict[str, float], total: int = 1000) -> dict[str, int]:
    """Whole weights that sum to total, by largest remainders, none below 1."""
    whole = sum(targets.values())
    exact = {s: t * total / whole for s, t in targets.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, total - sum(out.values()))]:
        out[s] += 1
    return out


def schedule(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period, earliest deadline first."""
    if any(not isinstance(a, int) or a < 1 for a in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    total = sum(weights.values())
    out: dict[str, list[int]] = {s: [] for s in weights}
    for t in range(total):
        ready = [(-(-(len(out[s]) + 1) * total // a), s) for s, a in weights.items() if len(out[s]) < a and len(out[s]) * total // a <= t]
        due, s = min(ready)
        assert t < due
        out[s].append(t)
    return out


def _placed(docs: DataFrame, weights: dict[str, int], other: int, block_rows: int) -> DataFrame:
    """Columns ``row`` (all of docs, so that no name can clash) and ``mix``."""
    weights = {**weights, OTHER: other}
    total = sum(weights.values())
    slots = schedule(weights)
    stream = F.when(F.col("row.source").isin([w for w in weights if w != OTHER]), F.col("row.source")).otherwise(F.lit(OTHER))
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("_mix", F.struct(stream.alias("stream"), digest.alias("hash"), F.substring(digest, 1, DIGITS).alias("digits")))
    counts = rows.groupBy(F.col("_mix.stream").alias("_stream"), F.col("_mix.digits").alias("_digits")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_stream").orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_stream", "_digits", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_mix.stream", "_mix.digits").orderBy("_mix.hash", "row.doc_id"))
    ranked = rows.withColumn("_rank", local).join(F.broadcast(offsets), (F.col("_mix.stream") == F.col("_stream")) & (F.col("_mix.digits") == F.col("_digits")))
    rank = F.col("_rank") - 1 + F.col("_before")
    block = F.floor(rank / block_rows)
    weight = F.element_at(F.create_map(*[F.lit(x) for s, a in weights.items() for x in (s, a)]), F.col("_mix.stream"))
    table = F.create_map(*[x for s in weights for x in (F.lit(s), F.array(*[F.lit(t) for t in slots[s]]))])
    slot = F.floor(F.col("_block") / F.col("_weight")) * total + F.element_at(F.element_at(table, F.col("_mix.stream")), (F.col("_block") % F.col("_weight") + 1).cast("int"))
    done = ranked.withColumn("_block", block).withColumn("_weight", weight).withColumn("_place", rank % block_rows)
    return done.select(
        "row",
        F.struct(
            F.col("_mix.stream").alias("stream"), (F.col("_block") + 1).cast("long").alias("block"), F.col("_place").cast("int").alias("row"),
            F.floor(F.col("_block") * total / F.col("_weight")).cast("long").alias("release"), F.ceil((F.col("_block") + 1) * total / F.col("_weight")).cast("long").alias("deadline"), slot.cast("long").alias("slot"),
        ).alias("mix"),
    )


def place(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with a column ``_mix`` (in place of one of that name): stream, block (from 1), row in the block (from 0), release, deadline, slot."""
    return _placed(docs.drop("_mix"), weights, other, block_rows).select("row.*", F.col("mix").alias("_mix"))


def mixed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs in the order of the mix: files written from it hold it in the order of their names."""
    return _placed(docs, weights, other, block_rows).orderBy("mix.slot", "mix.row").select("row.*")
