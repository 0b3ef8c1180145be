"""Repair of conversations whose turns were lost, doubled, cut off or given to the wrong side.

A row's first fault is blank (no character beside U+0020 and U+0009 to U+000D), duplicate (its
role and text stood earlier in the conversation) or truncated (the last such character is none
of ``.!?``).  The cheapest edits then give the conversation a legal order of roles: an optional
system turn, then user and assistant by turns, ending with the assistant.  K keeps a row (0),
R gives it to the user or the assistant (3), D deletes it (4, asked for where it is blank
or a duplicate), I inserts an empty user or assistant turn (3); a truncated row that stays adds 3.
Of equally cheap repairs the one whose initials come first in ASCII is taken.

Four states are enough: nothing said yet, system, user, assistant said last.  ``aggregate()`` goes
over the sorted rows and carries for each state the least (cost, audit) that leads there.
Where an insertion may stand before or after a deletion, D first is the lesser text, so
insertions stand only before rows that stay; then no audit of one length in rows is the beginning of
another, and the least audit of a state stays least whatever follows.

Conversations of any length.  Rows are dealt out by range of (conversation, turn, role, text),
exact copies by their number too, and are kept in the shared folder by part and place: no part
is one conversation's whole unless it is small.  Blocks are BLOCK places of a part; within them
rows are collected and folded, once from each state that may come before, and a second fold over the
blocks of a conversation joins their (cost, audit) tables, audits as lists of the blocks' texts.
Copies are flagged by two windows, one inside each part and one over the first of each part.
Texts move twice: by range as a hash and their first 32 characters only, and by conversation for the digest,
which takes the sorted rows as a stream (a digest is made in order, in one task; it holds one row at a time).

Defined results.  Null roles and texts are one blank, null turns stand first, a null conv_id is
a conversation of its own.  Rows of one turn stand by role, then by the first 32 characters and
the MD5 of their text.  Roles that do not start with s, u or a cannot be kept.  gaps beyond a long are the
greatest long.  An empty table gives an empty one.  Other columns, whatever their names,
are not read.  The number that parts exact copies is that of the row in its input, so the input is to be
a table read from files, whose rows come again in the same order when a task runs again.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import bounded_batches, buckets, cut, discard, packed

BLOCK = 1024
BLANKS = " \t\n\x0b\x0c\r"
NEVER = 1 << 40  # the cost of a state that cannot be; sums of it stay far below a long's end
STATES = ("none", "system", "user", "assistant")
LEGAL = ("su", "ua", "au")
PREFIX = 32


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with rows dropped, emptied, cut, doubled or given to the user, by the crc32 of ``conv_id:turn``."""
    blank = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _after(path: Column, cost, letter) -> Column:
    letter = letter if isinstance(letter, Column) else F.lit(letter)
    return _path(path["cost"] + cost, F.concat(path["audit"], letter))


def _states(*paths: Column) -> Column:
    return F.struct(*[p.alias(s) for s, p in zip(STATES, paths)])


def _step(at: Column, row: Column) -> Column:
    """The four least paths after one more row (initial, fault)."""
    gone = (row["fault"] == "blank") | (row["fault"] == "duplicate")
    more = F.when(row["fault"] == "truncated", F.lit(3)).otherwise(F.lit(0))

    def said(before: Column) -> Column:
        before_user = F.least(before["free"], _after(before["user"], 3, "I"))
        before_assistant = F.least(before["user"], _after(before["free"], 3, "I"))
        return _let(F.struct(before_user.alias("user"), before_assistant.alias("assistant")), lambda p: stays(p))

    def stays(p: Column) -> Column:
        def one(state: str, initial: str) -> Column:
            own = row["initial"] == initial
            stay = _after(p[state], more + F.when(own, F.lit(0)).otherwise(F.lit(3)), F.when(own, "K").otherwise("R"))
            drop = _after(at[state], 4, "D")
            return F.when(gone, drop).otherwise(F.least(drop, stay))

        opened = F.when(gone | (row["initial"] != "s"), _after(at["system"], 4, "D")).otherwise(F.least(_after(at["system"], 4, "D"), _after(at["none"], more, "K")))
        return _states(_after(at["none"], 4, "D"), opened, one("user", "u"), one("assistant", "a"))

    # free: from where a user may speak next without an insertion
    return _let(F.struct(F.least(at["none"], at["system"], at["assistant"]).alias("free"), at["user"].alias("user")), said)


def _fold(rows: Column, start: str) -> Column:
    zero = _states(*[_path(F.lit(0 if s == start else NEVER), F.lit("")) for s in STATES])
    return F.aggregate(rows, zero, _step)


def _joined(at: Column, block: Column) -> Column:
    """The least paths (cost, list of audits) after one more block's table."""

    def through(state: str) -> Column:
        ways = []
        for s in STATES:
            step = block["table"][s][state]
            ways.append(F.when(step.isNotNull(), F.struct((at[s]["cost"] + step["cost"]).alias("cost"), F.concat(at[s]["audits"], F.array(step["audit"])).alias("audits"))))
        return F.least(*ways)

    return _states(*[through(s) for s in STATES])


def _ended(at: Column) -> Column:
    """The least of the paths that may end a conversation; insertions after its last row are an audit of their own."""

    def closed(state: str, cost: int, letters: str) -> Column:
        return F.struct((at[state]["cost"] + cost).alias("cost"), F.concat(at[state]["audits"], F.array(F.lit(letters))).alias("audits"))

    return F.least(closed("none", 0, ""), closed("assistant", 0, ""), closed("user", 3, "I"), closed("system", 6, "II"))


def placed(rows: DataFrame) -> DataFrame:
    """Slim rows (part, place, block, conv_id, turn, role, head, hash, initial, shape), in the shared folder and in order within each part."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    shape = F.when(end == "", "blank").when(F.right(end, F.lit(1)).isin(".", "!", "?"), "whole").otherwise("truncated")
    slim = rows.select("conv_id", "turn", "role", F.substring("text", 1, PREFIX).alias("head"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"), F.substring("role", 1, 1).alias("initial"), shape.alias("shape"), F.monotonically_increasing_id().alias("_row"))
    keys = ["conv_id", "turn", "role", "head", "hash", "_row"]
    dealt = slim.repartitionByRange(buckets(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    return cut(dealt.select(F.shiftright(place, 33).alias("part"), F.expr("monotonically_increasing_id() & 8589934591").alias("place"), *[k for k in keys if k != "_row"], "initial", "shape"), "repair-rows")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row a block of a conversation: its counts, its ends and its tables of least paths."""
    same = ["conv_id", "role", "hash"]
    inside = F.row_number().over(Window.partitionBy(*same, "part").orderBy("place"))
    seen = rows.select("part", "place", "conv_id", "turn", "role", "hash", "initial", "shape").withColumn("_nth", inside)
    plain = ["part", "place", "conv_id", "turn", "initial", "shape"]
    first = seen.where("_nth = 1").withColumn("_of", F.row_number().over(Window.partitionBy(*same).orderBy("part"))).select(*plain, (F.col("_of") > 1).alias("again"))
    flagged = first.union(seen.where("_nth > 1").select(*plain, F.lit(True).alias("again")))
    fault = F.when(F.col("shape") == "blank", "blank").when(F.col("again"), "duplicate").when(F.col("shape") == "truncated", "truncated").otherwise("")
    block = F.floor(F.col("place") / BLOCK).cast("long")
    held = flagged.withColumn("block", block).groupBy("conv_id", "part", "block").agg(F.array_sort(F.collect_list(F.struct("place", "initial", fault.alias("fault"), "turn"))).alias("rows"))
    count = lambda f: F.size(F.filter("rows", lambda r: r["fault"] == f)).cast("long")
    pair = lambda a, b: ~F.concat(a, b).isin(*LEGAL)
    initials = F.transform("rows", lambda r: r["initial"])
    illegal = F.size(F.filter(F.zip_with(F.slice(initials, 1, F.size("rows") - 1), F.slice(initials, 2, F.size("rows")), pair), lambda x: x)).cast("long")
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    # a block whose first row is the first of its places may have rows before it; any other opens its conversation
    opens = F.col("rows")[0]["place"] > F.col("block") * BLOCK
    none = F.lit(None).cast("struct<" + ",".join(f"{s}:struct<cost:bigint,audit:string>" for s in STATES) + ">")
    table = F.struct(*[_fold(F.col("rows"), s).alias(s) if s == "none" else F.when(~opens, _fold(F.col("rows"), s)).otherwise(none).alias(s) for s in STATES])
    return held.select(
        "conv_id", "part", "block", count("blank").alias("blank"), count("duplicate").alias("duplicate"), count("truncated").alias("truncated"), illegal.alias("illegal"),
        F.get(initials, F.lit(0)).alias("first"), F.element_at(initials, -1).alias("last"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(F.array_distinct(turns)).cast("long").alias("turns"), table.alias("table"),
    )


def solved(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations in rows."""
    slim = placed(rows)
    held = _blocks(slim).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "block", "first", "last", "low", "high", "table"))).alias("blocks"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("low").alias("low"), F.max("high").alias("high"),
    )
    neighbours = lambda test: F.size(F.filter(F.zip_with(F.slice("blocks", 1, F.size("blocks") - 1), F.slice("blocks", 2, F.size("blocks")), test), lambda x: x))
    crossing = neighbours(lambda a, b: ~F.concat(a["last"], b["first"]).isin(*LEGAL))
    shared = neighbours(lambda a, b: a["high"] == b["low"])  # a turn that goes on in the next block
    wide = F.col("high").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)") + 1 - F.col("turns") + shared
    gaps = F.when(F.col("high").isNull(), F.lit(0).cast("long")).otherwise(F.least(wide, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long"))
    zero = _states(*[F.struct(F.lit(0 if s == "none" else NEVER).cast("long").alias("cost"), F.array().cast("array<string>").alias("audits")) for s in STATES])
    best = F.aggregate("blocks", zero, _joined, _ended)
    out = held.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + crossing).alias("illegal"), best.alias("_best"))
    out = cut(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("_best.cost").alias("cost"), F.array_join("_best.audits", "").alias("audit")), "repair-solved")
    discard(slim)
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation in one partition: a row of its findings, then its rows in order."""
    found = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct().alias("c").join(solved(rows).alias("s"), F.expr("c.conv_id <=> s.conv_id"), "left")
    heads = found.select("c.conv_id", *[F.coalesce(f"s.{c}", F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("s.audit", F.lit("")).alias("audit"), *[F.lit(None).cast(t).alias(n) for n, t in (("role", "string"), ("text", "string"), ("turn", "long"), ("_head", "string"), ("_hash", "binary"))])
    texts = rows.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"), "role", "text", "turn", F.substring("text", 1, PREFIX).alias("_head"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("_hash"))
    # audits are not null in the rows of findings alone, which so stand first
    both = heads.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "_head", "_hash")
    return both.select("conv_id", *COUNTS, "audit", "role", "text")


def _walk(batches):
    """(findings, None) where a conversation opens, and (role, text) for each turn of the repaired one."""
    names = ("user", "assistant")
    audit, at, said = "", 0, 0

    def inserted():
        nonlocal at, said
        while at < len(audit) and audit[at] == "I":
            at += 1
            said += 1
            yield names[(said - 1) % 2], ""

    for batch in batches:
        for *found, edits, role, text in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            yield from inserted()
            if edits is not None:
                audit, at, said = edits, 0, 0
                yield (*found, edits), None
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                opening = edit == "K" and role[:1] == "s"
                yield (role if edit == "K" else names[said % 2]), text
                said += not opening
    yield from inserted()


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of conversations, whose turns are rows."""
    bounded_batches(rows.sparkSession)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def work(batches):
        done, head, sha, more = [], None, None, False
        size = 0
        for a, b in _walk(batches):
            if b is not None:
                sha.update(f"{chr(10) if more else ''}{a}:{b}".encode())
                more = True
                continue
            if head is not None:
                done.append((*head, sha.hexdigest()))
                size += len(head[-1])
                if len(done) == 2000 or size > 1 << 23:
                    yield packed(schema, done)
                    done, size = [], 0
            head, sha, more = a, hashlib.sha256(), False
        if head is not None:
            yield packed(schema, [*done, (*head, sha.hexdigest())])

    return _stream(conversations, rows).mapInArrow(work, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations, places from 0."""
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), *[F.coalesce(conversations[c].cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    bounded_batches(rows.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def work(batches):
        done, conv, place, size = [], None, 0, 0
        for a, b in _walk(batches):
            if b is None:
                conv, place = a[0], 0
                continue
            done.append((conv, place, a, b))
            place += 1
            size += len(b)
            if len(done) == 2000 or size > 1 << 23:
                yield packed(schema, done)
                done, size = [], 0
        if done:
            yield packed(schema, done)

    return _stream(conversations, rows).mapInArrow(work, "conv_id long, place long, role string, text string")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The report of conversations after damage."""
    return report(conversations, damaged(conversations))
