r"""TeX as a table of tokens, by DataFrame functions; brackets of whole texts also by numpy in a task.

A token is a comment, a stretch of code (a literal environment or an inline listing), a command
with its name, a brace or bracket, a dollar sign, or a run of anything else; end to end they are the text.
One regular expression reads them, so what stands in code is code whatever it looks like.

* ``visible`` and ``without_comments`` blank tokens of a text in place: no exchange.
* ``math_ranges`` folds over the marks of a text, in pieces of PIECE marks whose findings are joined
  once, so that its work stays linear.
* ``table``, ``spans`` and ``groups`` give rows.  Depths are prefix sums in a window, a brace that closes
  nothing is found by the running minimum of that sum, and the partner of an opening brace is the next
  brace of its (text, depth).  All brackets of a text are matched at once, whatever they hold.
* ``text_groups`` gives the rows of ``groups`` without a row for each token and without an exchange: a text's
  tokens stay one array beside its key, and a task matches brackets in stretches of BRACKETS_AT_ONCE tokens or one text.

Positions count characters from 0.  Null texts give null columns and no rows.  Blanks between ``\begin``
and its name, and the names of commands, are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.tex.scan import CODE_ENVIRONMENTS, LITERAL_CONSTRUCTORS, MATH_ENVIRONMENTS

PIECE = 512
BRACKETS_AT_ONCE = 1 << 19
_NAME = r"\\[A-Za-z@]+|\\.?"
_INLINE_CODE = r"\\(?:(?>verb\*?(?![A-Za-z@]))|(?>lstinline\*?(?![A-Za-z@]))\s*+(?:\[[^\]\n]*\]\s*+)?+)(?:\{[^}\n]*\}|([^\p{IsWhite_Space}{])[^\n]*?\2)"
_PLAIN = r"[^\\%${}\[\]]+|\$\$?|[{}\[\]]"


def _quoted(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)])


def pattern(environments: Column | None = None) -> Column:
    """The expression that reads tokens, where environments are literal beside the fixed ones."""
    names = _names(CODE_ENVIRONMENTS) if environments is None else F.array_union(_names(CODE_ENVIRONMENTS), environments)
    code = F.concat(F.lit(r"\\begin\s*\{("), _quoted(names), F.lit(r")\}.*?(?:\\end\s*\{\1\}|\z)"))
    return F.concat(F.lit(r"(?s)%[^\n]*|"), code, F.lit("|" + _INLINE_CODE + "|" + _NAME + "|" + _PLAIN))


def read(text: Column, environments: Column | None = None) -> Column:
    """The tokens of a text, in order."""
    return F.regexp_extract_all(text, pattern(environments), F.lit(0))


def is_comment(token: Column) -> Column:
    return token.startswith("%")


def is_code(token: Column) -> Column:
    """Code is longer than the command that opens it."""
    return token.rlike(r"^\\(?:begin|verb|lstinline)[^A-Za-z@]")


def _blank(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\n]", " ")


def _shown(text: Column, hidden, environments: Column | None = None) -> Column:
    return F.array_join(F.transform(read(text, environments), lambda t: F.when(hidden(t), _blank(t)).otherwise(t)), "")


def without_comments(text: Column) -> Column:
    """STR9: comments as blanks, every position kept; code is not looked for."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)%[^\n]*|\\.?|[^\\%]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(is_comment(t), _blank(t)).otherwise(t)), "")


def _declared(seen: Column) -> Column:
    """Names of the literal environments that a text declares: a constructor, its options, a name, and arguments that follow."""
    found = F.regexp_extract_all(seen, F.lit(r"(?<!\\)(?:\\\\)*\\(?:" + "|".join(LITERAL_CONSTRUCTORS) + r")\s*(?:\[[^\]]*\]\s*)?\{([A-Za-z@][A-Za-z0-9_:@*.-]*)\}(?=\s*(?:\[[^\]]*\]\s*)*\{)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda n: n != "document"))


def declared_environments(text: Column) -> Column:
    """STR11: the literal environments that a text declares, in two passes.

    The second reads with all names of the first as code, so that a declaration printed in a
    listing declares nothing, wherever the listing's own declaration stands.
    """
    opens = text.rlike(r"\\(?:" + "|".join(LITERAL_CONSTRUCTORS) + ")")
    shown = lambda names: _shown(text, lambda t: is_comment(t) | is_code(t), names)
    none = F.array().cast("array<string>")
    return F.when(text.isNotNull(), F.when(opens, _declared(shown(_declared(shown(none))))).otherwise(none))


def visible(text: Column, environments: Column | None = None) -> Column:
    """STR10: comments and code as blanks, every position and line end kept.

    environments are literal beside the fixed ones: those of declared_environments, or of the whole project.
    """
    return _shown(text, lambda t: is_comment(t) | is_code(t), environments)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def math_ranges(seen: Column) -> Column:
    """TX4: (start, end) of the mathematics in a visible text; what groups inside it hold does not end it.

    Mathematics without an end lasts to the text's end.
    """
    marks = F.regexp_extract_all(seen, F.lit(r"(?s)[^\\${}]*+(?:\\(?:begin|end)\s*\{[^{}]+\}|\\[A-Za-z@]+\*?|\\.?|\$\$?|[{}]|\z)"), F.lit(0))
    ranges = "array<struct<start:bigint,end:bigint>>"
    state = lambda at, closing, opening, since, groups, nested, out: F.struct(
        at.cast("long").alias("at"), closing.alias("closing"), opening.alias("opening"), since.cast("long").alias("since"), groups.cast("int").alias("groups"), nested.cast("int").alias("nested"), out.cast(ranges).alias("out")
    )
    zero, none = F.lit(0), F.lit("")

    def step(s: Column, piece: Column) -> Column:
        mark = F.regexp_extract(piece, r"(?s)^[^\\${}]*(.*)$", 1)
        return _let(F.struct(mark.alias("mark"), F.length(piece).alias("n")), lambda x: taken(s, x["mark"], s["at"] + x["n"]))

    def taken(s: Column, mark: Column, end: Column) -> Column:
        return _let(F.regexp_replace(mark, r"^\\(begin|end)\s+\{", r"\\$1{"), lambda m: moved(s, m, F.length(mark), end))

    def moved(s: Column, m: Column, length: Column, end: Column) -> Column:
        environment = F.regexp_extract(m, r"^\\begin\{(.*)\}$", 1)
        closes = F.when(m.isin("$", "$$"), m).when(m == r"\(", F.lit(r"\)")).when(m == r"\[", F.lit(r"\]")).when(environment.isin(*sorted(MATH_ENVIRONMENTS)), F.concat(F.lit(r"\end{"), environment, F.lit("}"))).otherwise(none)
        began = state(end, closes, F.when(environment != "", m).otherwise(none), end - length, zero, F.lit(1), s["out"])
        outside = F.when(m.startswith("$") | m.startswith("\\"), began).otherwise(state(end, none, none, zero, zero, zero, s["out"]))
        groups = F.when(m.isin("{", r"\bgroup", r"\begingroup"), s["groups"] + 1).when(m.isin("}", r"\egroup", r"\endgroup"), F.greatest(s["groups"] - 1, zero)).otherwise(s["groups"])
        level = s["groups"] == 0
        ends = level & F.when(s["closing"].startswith("$"), m.startswith(s["closing"])).otherwise((m == s["closing"]) & (s["nested"] == 1))
        stop = F.when(s["closing"].startswith("$"), end - length + F.length(s["closing"])).otherwise(end)
        nested = s["nested"] + F.when(level & (m == s["opening"]), F.lit(1)).when(level & (m == s["closing"]), F.lit(-1)).otherwise(zero)
        inside = F.when(ends, state(end, none, none, zero, zero, zero, F.concat(s["out"], F.array(F.struct(s["since"].alias("start"), stop.alias("end")))))).otherwise(state(end, s["closing"], s["opening"], s["since"], groups, nested, s["out"]))
        return F.when(s["closing"] == "", outside).otherwise(inside)

    empty = F.array().cast(ranges)
    start = F.struct(state(zero, none, none, zero, zero, zero, empty).alias("s"), F.array().cast(f"array<{ranges}>").alias("done"))

    def whole(m: Column) -> Column:
        def folded(acc: Column, i: Column) -> Column:
            return _let(F.aggregate(F.slice(m, i * PIECE + 1, F.lit(PIECE)), acc["s"], step), lambda t: F.struct(state(t["at"], t["closing"], t["opening"], t["since"], t["groups"], t["nested"], empty).alias("s"), F.concat(acc["done"], F.array(t["out"])).alias("done")))

        number = F.sequence(zero, F.floor(F.size(m) / PIECE).cast("int"))
        last = lambda acc: F.concat(F.flatten(acc["done"]), F.when(acc["s"]["closing"] != "", F.array(F.struct(acc["s"]["since"].alias("start"), F.length(seen).cast("long").alias("end")))).otherwise(empty))
        return F.aggregate(number, start, folded, last)

    return F.when(seen.isNotNull(), _let(marks, whole))


# Commands that read or write a file.
PATH_COMMANDS = ("input", "include", "includegraphics", "openin", "openout")


def path_violations(seen: Column, main: Column | None = None) -> Column:
    """FP7: names of files in a visible text that are absolute, name a pipe or leave the project, each once in order.

    Names stand in braces or up to a blank.  Names with ``..`` are judged from the folder of the project's main file.
    """
    call = r"\\(?:" + "|".join(PATH_COMMANDS) + r")(?![A-Za-z@])\s*(?:\[[^\]]*\])?\s*"
    found = F.regexp_extract_all(seen, F.lit(call + r"(?:\{[^{}]*\}|[^\s{}%]+)"), F.lit(0))
    names = F.transform(found, lambda m: F.regexp_replace(F.regexp_replace(m, "^" + call, ""), r"(?U)^\{?\s*|\s*\}?$", ""))
    start = F.lit(0) if main is None else F.size(F.filter(F.split(main, "/"), lambda p: ~p.isin("", "."))) - 1

    def leaves(name: Column) -> Column:
        place = lambda depth, out: F.struct(depth.cast("int").alias("depth"), out.alias("out"))
        down = lambda s, p: s["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
        return F.aggregate(F.split(name, "/"), place(start, F.lit(False)), lambda s, p: place(down(s, p), s["out"] | (down(s, p) < 0)), lambda s: s["out"])

    return F.array_distinct(F.filter(names, lambda n: n.rlike(r"^(?:[/~|]|[A-Za-z]:)") | leaves(n)))


def table(texts: DataFrame, key: str, text: str = "text", environments: str | None = None) -> DataFrame:
    """(key, ord, start, end, size, kind, token) of the tokens of each text, a run's token null; size is the text's.

    Kinds: comment, code, command, dollar, open, close (braces), option, option_end (brackets), run.
    """
    # the size is taken before the rows are dealt out: a text beside each of its tokens would be copied as often
    rows = texts.select(F.col(key).alias("_key"), F.length(text).cast("long").alias("size"), read(F.col(text), F.col(environments) if environments else None).alias("_all")).select("_key", "size", F.posexplode("_all").alias("ord", "_t"))
    t = F.col("_t")
    kind = F.when(is_comment(t), "comment").when(is_code(t), "code").when(t.startswith("\\"), "command").when(t.startswith("$"), "dollar").when(t == "{", "open").when(t == "}", "close").when(t == "[", "option").when(t == "]", "option_end").otherwise("run")
    slim = rows.select("_key", "ord", "size", F.length(t).cast("long").alias("_n"), kind.alias("kind"), t.alias("_t")).withColumn("token", F.when(F.col("kind") != "run", F.col("_t"))).drop("_t")
    end = F.sum("_n").over(Window.partitionBy("_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return slim.withColumn("end", end).select(F.col("_key").alias(key), "ord", (F.col("end") - F.col("_n")).alias("start"), "end", "size", "kind", "token")


def spans(tokens: DataFrame, key: str) -> DataFrame:
    """STR9, STR10: (key, start, end, kind) of what a text hides: its comments and code."""
    return tokens.where(F.col("kind").isin("comment", "code")).select(key, "start", "end", "kind")


def groups(tokens: DataFrame, key: str) -> DataFrame:
    """TX2: (key, start, end, kind, depth, parent, closed) of each group ({) and option ([).

    depth counts the groups around it, parent is where the innermost begins (null: none).  A group that does
    not close lasts to the text's end.  An option ends at the first ``]`` of its own depth and
    group; one that its group cuts off lasts to the text's end, as nothing closes it.
    """
    upto = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    t = tokens.where(kind.isin("open", "close", "option", "option_end")).select(key, "ord", "start", "end", "size", "kind")
    t = t.withColumn("_sum", F.sum(F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)).over(upto)).withColumn("_low", F.least(F.lit(0), F.min("_sum").over(upto)))
    before = F.coalesce(F.lag("_low").over(Window.partitionBy(key).orderBy("ord")), F.lit(0))
    t = t.withColumn("_before", before).where((kind != "close") | (F.col("_low") == F.col("_before"))).withColumn("_depth", F.col("_sum") - F.col("_low"))
    # a brace stands at the level inside it, where the two of a group follow each other, and
    # an opening one, as an option, also at the level around it, where the last brace is its parent's
    at = lambda level, edge: F.struct(level.cast("int").alias("level"), F.lit(edge).alias("edge"))
    levels = F.when(kind == "open", F.array(at(F.col("_depth"), True), at(F.col("_depth") - 1, False))).when(kind == "close", F.array(at(F.col("_depth") + 1, True))).otherwise(F.array(at(F.col("_depth"), False)))
    t = t.withColumn("_at", F.explode(levels)).select(key, "ord", "start", "end", "size", "kind", F.col("_at.level").alias("_level"), F.col("_at.edge").alias("_edge"))
    edge, opens = F.col("_edge"), F.col("kind") == "open"
    t = t.withColumn("_close", F.when(edge & opens, F.lead("end").over(Window.partitionBy(key, "_level", "_edge").orderBy("ord"))))
    t = t.withColumn("_parent", F.when(~edge, F.last(F.when(edge & opens, F.col("start")), ignorenulls=True).over(Window.partitionBy(key, "_level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))))
    back = Window.partitionBy(key, "_level", "_edge", "_parent").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    option_end = F.last(F.when(F.col("kind") == "option_end", F.col("end")), ignorenulls=True).over(back)
    t = t.withColumn("_close", F.when(F.col("kind") == "option", option_end).otherwise(F.col("_close"))).where(F.col("kind").isin("open", "option"))
    found = t.groupBy(key, "ord").agg(F.first("start").alias("start"), F.first("size").alias("size"), F.first("kind").alias("kind"), F.max("_close").alias("_close"), F.max("_parent").alias("parent"), F.min("_level").alias("depth"))
    return found.select(key, "start", F.coalesce("_close", "size").alias("end"), F.when(F.col("kind") == "open", "{").otherwise("[").alias("kind"), "depth", "parent", F.col("_close").isNotNull().alias("closed"))


_OPEN, _CLOSE, _OPTION, _OPTION_END = 1, 2, 3, 4
_BRACKETS = pa.array(["{", "}", "[", "]"])


def _matched(text: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end, kind, depth, parent, closed) of the groups of brackets that stand in order of text and start; parent -1: none."""
    step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
    # a running minimum over all texts at once: each text begins so far below the one before that none of that one's sums is lower
    fall = text * (2 * len(text) + 2)
    sums = np.cumsum(step)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    sums -= np.repeat(sums[first] - step[first], np.diff(np.append(first, len(text))))
    low = np.minimum.accumulate(np.minimum(sums, 0) - fall) + fall
    before = np.concatenate(([0], low[:-1]))
    before[first] = 0
    kept = (kind != _CLOSE) | (low == before)
    depth = (sums - low)[kept]
    text, start, end, size, kind = (x[kept] for x in (text, start, end, size, kind))
    at, opens = np.arange(len(text)), kind == _OPEN
    inside = np.where(opens, depth, depth + 1)  # of a brace: the level that its group holds
    closing = np.full(len(text), -1)
    braces = at[opens | (kind == _CLOSE)]
    braces = braces[np.lexsort((braces, inside[braces], text[braces]))]
    pair = np.flatnonzero(opens[braces[:-1]] & (kind[braces[1:]] == _CLOSE) & (text[braces[1:]] == text[braces[:-1]]) & (inside[braces[1:]] == inside[braces[:-1]]))
    closing[braces[pair]] = end[braces[pair + 1]]
    around = np.where(opens, depth - 1, depth)
    # levels that hold a parent: (text, level, place) as one number, which fits, as a stretch has few tokens
    n = np.int64(len(text) + 1)
    level = lambda of, at_level: (text[of] - (text[0] if len(text) else 0)) * n + at_level
    parents = at[opens][np.argsort(level(at[opens], depth[opens]) * n + at[opens], kind="stable")]
    asked = at[opens | (kind == _OPTION) | (kind == _OPTION_END)]
    found = np.searchsorted(level(parents, depth[parents]) * n + parents, level(asked, around[asked]) * n + asked) - 1
    parent = np.full(len(text), -1)
    parent[asked] = np.where(around[asked] > 0, parents[found] if len(parents) else -1, -1)
    options, ends = at[kind == _OPTION], at[kind == _OPTION_END]
    # of one text and group: options have the level of their parent, so text and parent tell them apart
    key = lambda of: (level(of, parent[of] + 1)) * n + of
    ends = ends[np.argsort(key(ends), kind="stable")]
    nxt = np.searchsorted(key(ends), key(options))
    if len(ends) and len(options):
        to = ends[np.minimum(nxt, len(ends) - 1)]
        same = (nxt < len(ends)) & (text[to] == text[options]) & (parent[to] == parent[options])
        closing[options[same]] = end[to[same]]
    out = at[opens | (kind == _OPTION)]
    shut = closing[out] >= 0
    return text[out], start[out], np.where(shut, closing[out], size[out]), opens[out], around[out], np.where(parent[out] >= 0, start[parent[out]], -1), shut


def text_groups(texts: DataFrame, key: str, text: str = "text", environments: str | None = None) -> DataFrame:
    """TX2: what groups gives for the tokens of each row's text, by row: rows that share a key are matched apart."""
    tokens = read(F.col(text), F.col(environments) if environments else None)
    rows = texts.select(F.col(key).alias("key"), tokens.alias("tokens"))
    held = dict(rows.dtypes)["key"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            offsets = batch.column(1).offsets.to_numpy()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BRACKETS_AT_ONCE, side="right")) - 1)
                part = batch.slice(lo, hi - lo)
                n = np.diff(offsets[lo : hi + 1])
                owner = np.repeat(np.arange(hi - lo), n)
                values = part.column(1).flatten()
                kind = pa.compute.index_in(values, _BRACKETS).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                length = pa.compute.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
                end = np.cumsum(length)
                at = np.concatenate(([0], end))[offsets[lo : hi + 1] - offsets[lo]]
                end -= np.repeat(at[:-1], n)
                size = np.diff(at)[owner]
                b = kind > 0
                row, start, stop, brace, depth, parent, closed = _matched(owner[b], (end - length)[b], end[b], size[b], kind[b])
                if len(row):
                    columns = [part.column(0).take(pa.array(row)), pa.array(start), pa.array(stop), pa.array(np.where(brace, "{", "[")), pa.array(depth.astype(np.int32)), pa.array(parent, mask=parent < 0), pa.array(closed)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "end", "kind", "depth", "parent", "closed"])
                lo = hi

    return rows.mapInArrow(match, f"key {held}, start long, end long, kind string, depth int, parent long, closed boolean").withColumnRenamed("key", key)
