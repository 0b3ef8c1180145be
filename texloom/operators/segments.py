"""Segment tables: keys, deduplication, cache join and writeback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segment_key(role: Column, source: Column, masked: Column, protected: Column) -> Column:
    """SG1, HS1: an address by content; lengths keep parts apart, and token layout counts."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(role), part(source), part(masked), F.concat_ws("", F.transform(protected, part))), 256)


def first_locations(segments: DataFrame) -> DataFrame:
    """AG1: one row for each key, with its first place and how often it occurs."""
    return segments.groupBy("key").agg(F.min(F.struct("file_no", "start")).alias("first"), F.count("*").alias("n")).select("key", "first.file_no", "first.start", "n")


def cache_join(unique: DataFrame, cache: DataFrame, config_hash: str) -> DataFrame:
    """JN3: unique keys with what the cache holds for them."""
    mine = cache.where(F.col("config_hash") == config_hash).select("key", "masked_translation")
    return unique.join(mine, "key", "left")


def misses(unique: DataFrame, cache: DataFrame, config_hash: str) -> DataFrame:
    """JN3: keys still to translate."""
    return unique.join(cache.where(F.col("config_hash") == config_hash).select("key"), "key", "left_anti")


def writeback(texts: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """JN4: texts with each segment's span replaced by its translation, or left as it is.

    texts (file, text), segments (file, start, end, key) with 0-based spans, translations (key, value).
    """
    t = segments.join(translations, "key", "left").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("spans"))
    rows = texts.join(t, "file", "left")
    return rows.select("file", spliced(F.col("text"), F.col("spans")).alias("text"))


def spliced(text: Column, spans: Column) -> Column:
    """JN4: a text with the values of ordered spans (start, end, value) in their places; null values leave it as it is."""
    kept = F.filter(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,value:string>>")), lambda s: s["value"].isNotNull())
    # pieces are gathered and joined once: the text is not copied for each span
    step = lambda a, s: F.struct(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["value"])).alias("out"), s["end"].cast("int").alias("at"))
    end = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    return F.aggregate(kept, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), step, end)


def unmask(masked: Column, protected: Column) -> Column:
    """SG5: a masked text with its protected spans put back, in the order of their numbers."""
    return F.aggregate(F.sequence(F.lit(0), F.size(protected) - 1), masked, lambda t, i: F.when(i < 0, t).otherwise(F.replace(t, F.format_string("⟪P%04d⟫", i), F.coalesce(F.get(protected, i), F.lit("")))))


def line_of(text: Column, start: Column) -> Column:
    """JN7: the line number of a 0-based position."""
    return F.lit(1) + F.regexp_count(F.substring(text, 1, start), F.lit("\n"))


def same_markers(a: Column, b: Column) -> Column:
    """AG13: whether two masked texts hold the same markers as multisets."""
    marks = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("(⟪P[0-9]{4,}⟫)"), F.lit(1)))
    return marks(a) == marks(b)


def fingerprint(files: DataFrame) -> DataFrame:
    """AG9: one digest of a project from its files in order of their paths."""
    each = F.struct("path", F.octet_length("content").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return files.groupBy("project").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(each))), 256).alias("fingerprint"))


def project_usage(results: DataFrame) -> DataFrame:
    """AG8: tokens, characters and whether any figure is an estimate."""
    return results.groupBy("job_id").agg(F.sum("tokens").alias("tokens"), F.sum("characters").alias("characters"), F.bool_or("estimated").alias("characters_estimated"))
