"""TeX operators on DataFrames. Rows go through Arrow batches; a task holds one text's segments at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions import response, text as text_rules
from texloom.tex import collect, requests, restore, rewrite
from texloom.tex.segment import Context, Segment, accented_text, segments

SEGMENT = "ord int, start int, end int, source string, masked string, protected array<string>, role string"
CONTEXT = "struct<text_macros: array<string>, math_aliases: map<string,string>, registers: map<string,string>, prose_arguments: map<string,array<int>>>"
ROWS = 2000


def _context(row) -> Context:
    if row is None:
        return Context()
    pairs = lambda m: dict(m.items() if hasattr(m, "items") else m or [])
    prose = {n: (int(v[0]), tuple(map(int, v[1:]))) for n, v in pairs(row["prose_arguments"]).items()}
    return Context(frozenset(row["text_macros"]), pairs(row["math_aliases"]), pairs(row["registers"]), prose)


def segment_table(texts: DataFrame, key: str, text: str = "text", context: str | None = None) -> DataFrame:
    """TX1: a row for each segment of each text, with the text's key and its place.

    Null and empty texts give none; other columns of texts are left out, and a join on key brings them back.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (F.col(context) if context else F.lit(None).cast(CONTEXT)).alias("_context"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        columns = ["_key", "ord", "start", "end", "source", "masked", "protected", "role"]
        for frame in frames:
            for k, t, c in frame.itertuples(index=False, name=None):
                for n, s in enumerate(segments(t, _context(c))):
                    out.append((k, n, s.start, s.end, s.source, s.masked, s.protected, s.role))
                    if len(out) >= ROWS:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(each, f"_key {kind}, {SEGMENT}").withColumnRenamed("_key", key)


def _vectorized(kind: str) -> Callable:
    """A function of series as a function of Columns; the UDF is made at its use, when a session exists."""

    def decorate(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def column(*columns) -> Column:
            return F.pandas_udf(function, kind)(*columns)

        return column

    return decorate


def _wrapped(function: Callable, kind: str) -> Callable[..., Column]:
    """A function of one text as a function of a Column; null for null."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    return _vectorized(kind)(run)


accented = _wrapped(accented_text, "string")
declarations = _wrapped(collect.declarations, "string")
literal_macros = _wrapped(collect.literal_macros, "map<string,string>")
title = _wrapped(collect.title, "string")
abstract = _wrapped(collect.abstract, "string")
entry_parts = _wrapped(collect.entry_parts, "string")
diagnose = _wrapped(rewrite.diagnose, "string")
float_positions = _wrapped(rewrite.float_positions, "string")
pixel_units = _wrapped(rewrite.pixel_units, "string")
comment_terminators = _wrapped(rewrite.comment_terminators, "string")
long_identifiers = _wrapped(rewrite.long_identifiers, "string")


@_vectorized("struct<text: string, count: int>")
def wide_tables(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, 0) if v is None else rewrite.wide_tables(v) for v in values], columns=["text", "count"])


@_vectorized("struct<text: string, count: int>")
def negative_spacers(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, 0) if v is None else rewrite.negative_spacers(v) for v in values], columns=["text", "count"])


@_vectorized("struct<value: string, error: string>")
def _restored(masked: pd.Series, protected: pd.Series, output: pd.Series, macros: pd.Series) -> pd.DataFrame:
    known = [dict(m.items() if hasattr(m, "items") else m or []) for m in macros]
    rows = [restore.restore(Segment(0, 0, "", m, list(p), literal_macros=k), o) if m is not None and p is not None else (None, "missing") for m, p, o, k in zip(masked, protected, output, known)]
    return pd.DataFrame(rows, columns=["value", "error"])


def restored(masked, protected, output, macros: Column | None = None) -> Column:
    """SG3: (value, error) for each masked text, its protected spans and a translation; macros are those that stand for plain text (TX8)."""
    return _restored(masked, protected, output, F.lit(None).cast("map<string,string>") if macros is None else macros)


@_vectorized("struct<value: string, error: string>")
def stripped(values: pd.Series) -> pd.DataFrame:
    """STR14: (value, error) of answers without their reasoning."""
    return pd.DataFrame([(None, None) if v is None else response.strip_reasoning(v) for v in values], columns=["value", "error"])


def cached_value(value: Column, source: Column, language: Column, service: Column) -> Column:
    """VL3: (value, error) of a cached translation: without reasoning, but for an XML service, and in the language asked for; null for null."""
    plain = F.struct(value.alias("value"), F.lit(None).cast("string").alias("error"))
    read = F.when(service == "deepl", plain).otherwise(text_rules.without_reasoning(value))
    error = F.coalesce(read["error"], text_rules.language_error(source, read["value"], language))
    return F.struct(F.when(error.isNull(), read["value"]).alias("value"), error.alias("error"))


@_vectorized("struct<xml: string, back: string, error: string>")
def transported(masked: pd.Series, protected: pd.Series) -> pd.DataFrame:
    """VL4: (xml, back, error): segments as XML, and read back from it."""
    rows = []
    for m, p in zip(masked, protected):
        xml, shown = requests.encode_xml(Segment(0, 0, "", m, list(p)))
        rows.append((xml, *(requests.decode_xml(xml, shown) if xml else (None, "invalid_xml"))))
    return pd.DataFrame(rows, columns=["xml", "back", "error"])


@_vectorized("string")
def payloads(masked: pd.Series, protected: pd.Series, surrounding: pd.Series) -> pd.Series:
    """EX2: the request of each segment."""
    return pd.Series([requests.payload(Segment(0, 0, "", m, list(p)), surrounding=s or "") for m, p, s in zip(masked, protected, surrounding)], dtype=object)


@_vectorized("array<string>")
def repair_chunks(masked: pd.Series, protected: pd.Series) -> pd.Series:
    return pd.Series([restore.repair_chunks(Segment(0, 0, "", m, list(p))) for m, p in zip(masked, protected)])


def includes(files: DataFrame, project: str, path: str, text: str = "text") -> DataFrame:
    """TX13: (project, path, ord, name, opaque) for each include of each file."""

    @F.pandas_udf("array<struct<name: string, opaque: boolean>>")
    def edges(values: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "opaque": o} for n, o in collect.include_edges(v or "")] for v in values])

    found = files.select(F.col(project).alias("project"), F.col(path).alias("path"), F.posexplode(edges(F.col(text))).alias("ord", "edge"))
    return found.select("project", "path", "ord", "edge.name", "edge.opaque")


def contexts(files: DataFrame) -> DataFrame:
    """TX6, TX7, TX11, TX12: (project, context) from files (project, path, text).

    A project is at most 4,000 files and 300 MB by the rules of its source; only declarations travel, whole ones.
    """
    joined = files.select("project", "path", declarations(F.col("text")).alias("d")).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("path", "d"))).alias("d"))

    @F.pandas_udf(CONTEXT)
    def read(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            c = collect.project_context(v or "")
            rows.append((sorted(c.text_macros), c.math_aliases, c.registers, {n: [k, *p] for n, (k, p) in c.prose_arguments.items()}))
        return pd.DataFrame(rows, columns=["text_macros", "math_aliases", "registers", "prose_arguments"])

    return joined.select("project", read(F.concat_ws("\n", F.transform("d", lambda x: x["d"]))).alias("context"))


def documents(files: DataFrame, mains: DataFrame) -> DataFrame:
    """GR3, TX15: (project, title, abstract, document) of each project from its files and main (project, main)."""
    whole = files.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("files")).join(mains, "project")

    @F.pandas_udf("struct<title: string, abstract: string, document: string>")
    def read(sources: pd.Series, main: pd.Series) -> pd.DataFrame:
        rows = []
        for f, m in zip(sources, main):
            text = collect.expand_includes(dict(f), m)
            rows.append((collect.title(text), collect.abstract(text), text))
        return pd.DataFrame(rows, columns=["title", "abstract", "document"])

    return whole.select("project", read("files", "main").alias("r")).select("project", "r.*")


def translated(found: DataFrame, client: Callable[[str, str | None], str], attempts: int = 3) -> DataFrame:
    """EX1, EX6: segments with (value, error, calls) of a client, called for each masked text with the last error.

    The client is any function that can be sent to the workers. Refused outputs keep the source.
    """

    @F.pandas_udf("struct<value: string, error: string, calls: int>")
    def call(source: pd.Series, masked: pd.Series, protected: pd.Series) -> pd.DataFrame:
        rows = [restore.translate(Segment(0, 0, s, m, list(p)), client, attempts) for s, m, p in zip(source, masked, protected)]
        return pd.DataFrame(rows, columns=["value", "error", "calls"])

    return found.withColumn("translation", call("source", "masked", "protected"))
