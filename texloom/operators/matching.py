"""Library items matched to papers: kinds of attachments, existing translations, originals and saved bindings.

Items are rows (parent_id, item_id, ...); what their notes say comes as columns, which
functions.records.marker_json reads.  Everything is an equi join or an aggregate with
map-side combination, so a parent with many items is not held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions import ids

# Words in the titles and file names of supplements.
SUPPLEMENT = r"(?i)\b(?:supplement(?:ary)?|appendix|slides?)\b|补充材料|附录|幻灯"


def is_pdf(is_file: Column, content_type: Column) -> Column:
    """FP8."""
    return F.coalesce(is_file & (F.lower(content_type) == "application/pdf"), F.lit(False))


def is_translation(title: Column, artifact: Column, provider: Column, prefix: str, name: str) -> Column:
    """FP8: an attachment that was made here, by the prefix of its title or the provider its note names; originals are none."""
    made = F.lower(F.trim(F.coalesce(title, F.lit("")))).startswith(prefix.lower()) | F.coalesce(provider == name, F.lit(False))
    return ~F.coalesce(artifact == "original", F.lit(False)) & made


def is_supplement(title: Column, filename: Column) -> Column:
    """FP8."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(filename, F.lit(""))).rlike(SUPPLEMENT)


def _translations(items: DataFrame) -> DataFrame:
    return items.where("is_pdf and artifact = 'translated' and available")


def matching_translation(requests: DataFrame, items: DataFrame) -> DataFrame:
    """FP9: (request_id, state, item_id): the translation that there is of a paper in a language; more than one is ambiguous."""
    keys = ["parent_id", "paper_id", "language"]
    found = _translations(items).groupBy(*keys).agg(F.count("*").alias("n"), F.min("item_id").alias("item_id"))
    state = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "found").otherwise("none")
    return requests.join(found, keys, "left").select("request_id", state.alias("state"), F.when(F.col("n") == 1, F.col("item_id")).alias("item_id"))


def saved_bindings(candidates: DataFrame, markers: DataFrame) -> DataFrame:
    """JN11: candidates (parent_id, key, fingerprint, paper_id, expected_base) with the id that translations have bound them to.

    An id of its own stays; else the markers (parent_id, artifact, source_key, source_fingerprint,
    paper_id) of the same key and file must name one version, of the base that is expected if one is.
    """
    bound = markers.where((F.col("artifact") == "translated") & ids.is_versioned(F.col("paper_id")))
    bound = bound.groupBy("parent_id", F.col("source_key").alias("key"), F.col("source_fingerprint").alias("fingerprint")).agg(F.min(F.lower("paper_id")).alias("_a"), F.max(F.lower("paper_id")).alias("_b"))
    one = F.when((F.col("_a") == F.col("_b")) & F.coalesce(ids.base_id(F.col("_a")) == F.col("expected_base"), F.col("expected_base").isNull()), F.col("_a"))
    joined = candidates.join(bound, ["parent_id", "key", "fingerprint"], "left")
    evidence = F.when(F.col("paper_id").isNotNull(), "attachment").when(one.isNotNull(), "saved-binding")
    return joined.select("parent_id", "key", F.coalesce("paper_id", one).alias("paper_id"), evidence.alias("evidence"))


def originals_of(translations: DataFrame, candidates: DataFrame) -> DataFrame:
    """JN11: (item_id, original, evidence): the original of each translation (item_id, parent_id, paper_id, source_key, source_fingerprint).

    The attachment it is bound to comes first, unless that names another paper; else the only
    candidate (parent_id, key, fingerprint, paper_id) of the same id.
    """
    asked = translations.where(ids.is_versioned(F.col("paper_id")))
    bound = asked.join(candidates.select("parent_id", F.col("key").alias("source_key"), F.col("fingerprint").alias("source_fingerprint"), F.col("paper_id").alias("_own")), ["parent_id", "source_key", "source_fingerprint"])
    bound = bound.where(F.coalesce(F.col("_own") == F.col("paper_id"), F.lit(True))).groupBy("item_id").agg(F.min("source_key").alias("_bound"))
    named = candidates.groupBy("parent_id", "paper_id").agg(F.count("*").alias("_n"), F.min("key").alias("_key"))
    both = asked.join(bound, "item_id", "left").join(named, ["parent_id", "paper_id"], "left")
    only = F.when(F.col("_n") == 1, F.col("_key"))
    return both.select("item_id", F.coalesce("_bound", only).alias("original"), F.when(F.col("_bound").isNotNull(), "saved-binding").when(only.isNotNull(), "attachment").alias("evidence"))


def default_pairs(sources: DataFrame, items: DataFrame) -> DataFrame:
    """FP11: (parent_id, original, translated): a resolved original (parent_id, original, paper_id) and the only translation of its id."""
    one = _translations(items).groupBy("parent_id", "paper_id").agg(F.count("*").alias("n"), F.min("item_id").alias("translated")).where("n = 1").drop("n")
    return sources.where(F.col("original").isNotNull()).join(one, ["parent_id", "paper_id"]).select("parent_id", "original", "translated")


def comparison_imports(wanted: DataFrame, attached: DataFrame) -> DataFrame:
    """UP8: for each job (job_id, parent_id, original_key) the original that is attached, else that of the job, and whether to import it."""
    have = attached.groupBy("parent_id", "original_key").agg(F.min("item_id").alias("_have"))
    both = wanted.join(have, ["parent_id", "original_key"], "left")
    return both.select("job_id", F.coalesce(F.col("_have").cast("string"), F.concat(F.lit("job:"), F.col("job_id").cast("string"))).alias("original"), F.col("_have").isNull().alias("imported"))
