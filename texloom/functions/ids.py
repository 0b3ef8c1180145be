"""Paper ids, versions and titles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of an id, and the hosts that serve papers.
PAPER_ID = r"(?:[0-9]{4}\.[0-9]{4,5}|[A-Za-z][A-Za-z.\-]+/[0-9]{7})(?:[vV][1-9][0-9]*)?"
PAPER_HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org")


def paper_id(value: Column) -> Column:
    """STR1: the id in a plain id, a prefixed id or a paper address; NULL if there is none."""
    v = F.trim(value)
    v = F.when(F.lower(v).startswith("arxiv:"), F.trim(F.substr(v, F.lit(7)))).otherwise(v)
    is_url = F.contains(v, F.lit("://"))
    host = F.lower(F.regexp_extract(v, r"^https?://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(v, r"^https?://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    path = F.regexp_replace(path, r"^(abs|pdf|src|e-print|html)/", "")
    v = F.when(is_url, F.when(host.isin(*PAPER_HOSTS), path)).otherwise(v)
    v = F.regexp_replace(v, r"\.pdf$", "")
    return F.when(v.rlike("^" + PAPER_ID + "$"), v)


def base_id(value: Column) -> Column:
    """STR3: an id without its version."""
    return F.lower(F.regexp_replace(value, r"[vV][0-9]+$", ""))


def is_versioned(value: Column) -> Column:
    """STR2: whether an id names its version."""
    return value.rlike(r"[vV][1-9][0-9]*$")


def version_number(value: Column) -> Column:
    """VL9: the version an id names, or NULL."""
    return F.when(is_versioned(value), F.regexp_extract(value, r"[vV]([0-9]+)$", 1).cast("int"))


def same_version(value: Column, expected: Column) -> Column:
    """VL9: same base, with an explicit version."""
    return (base_id(value) == base_id(expected)) & is_versioned(value)


def references(text: Column) -> Column:
    """STR3: the distinct ids in a text, in order."""
    pattern = r"(?i)(?:^|[^A-Za-z0-9_])((?:[0-9]{4}\.[0-9]{4,5}|[a-z][a-z.\-]+/[0-9]{7})(?:v[1-9][0-9]*)?)(?![A-Za-z0-9_])"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def placeholder_title(kind: Column, name: Column, identifier: Column) -> Column:
    """FP4: whether a paper's name is missing or only repeats its id."""
    low = F.lower(name)
    full = F.concat(F.lit("arxiv "), F.lower(identifier))
    base = F.concat(F.lit("arxiv "), F.lower(F.regexp_replace(identifier, r"v[0-9]+$", "")))
    empty = name.isNull() | (name == "")
    return F.coalesce((kind == "arxiv") & (identifier != "") & (empty | (low == full) | (low == base)), F.lit(False))


def version_newer(value: Column, than: Column) -> Column:
    """RK17: strict comparison of versions of three numbers; false if either is malformed."""
    shape = r"\Av?(?:0|[1-9][0-9]{0,14})(?:\.(?:0|[1-9][0-9]{0,14})){2}\z"
    parts = lambda c: F.transform(F.split(F.regexp_replace(c, "^v", ""), r"\."), lambda x: x.cast("long"))
    return F.coalesce(F.when(value.rlike(shape) & than.rlike(shape), parts(value) > parts(than)), F.lit(False))
