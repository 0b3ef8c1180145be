"""Records as Column expressions: JSON markers, header maps, base64, geometry and settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions.ids import base_id, references

# Headers that a client sets itself.
RESERVED_HEADERS = (
    "authorization", "host", "content-length", "content-type", "content-encoding", "accept-encoding", "connection", "keep-alive",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "expect",
)
# Entries, characters of a name and of a value, and the size of all with 4 for each entry.
MOST_HEADERS, NAME_LENGTH, VALUE_LENGTH, HEADERS_SIZE = 16, 128, 4096, 16384
MARKER_FIELDS = ("provider", "artifact", "task_id", "language", "arxiv_id")


def marker_json(note: Column, fields: tuple[str, ...] = MARKER_FIELDS) -> Column:
    """JS1: the string fields of a JSON note as a struct; NULL if one of them is no string or the JSON is damaged."""
    v = F.try_parse_json(note)
    is_text = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.lit(False))
    return F.when(reduce(lambda a, b: a & b, map(is_text, fields)), F.struct(*[F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in fields]))


def marker_note(*fields: str) -> Column:
    """JS2: a JSON note of columns."""
    return F.to_json(F.struct(*fields))


def headers_error(headers: Column) -> Column:
    """JS3: why a map of extra headers is refused, or NULL: the number of entries, then the first entry at fault."""
    entries = F.map_entries(headers)
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    sizes = F.transform(entries, lambda e: F.length(e["key"]) + F.length(e["value"]) + 4)
    up_to = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, n: a + n)
    fault = lambda e, i: (
        F.when((F.length(e["key"]) > NAME_LENGTH) | ~e["key"].rlike(r"\A[!#$%&'*+.^_`|~0-9A-Za-z-]+\z"), "invalid_name")
        .when(F.lower(e["key"]).isin(*RESERVED_HEADERS), "reserved_name")
        .when(F.array_position(names, F.lower(e["key"])) <= i, "repeated_name")
        .when(F.length(e["value"]) > VALUE_LENGTH, "long_value")
        .when(~e["value"].rlike(r"\A[\x20-\x7e]*\z"), "invalid_value")
        .when(up_to(i) > HEADERS_SIZE, "too_large")
    )
    first = F.get(F.filter(F.transform(entries, fault), lambda x: x.isNotNull()), 0)
    return F.when(headers.isNull() | F.exists(entries, lambda e: e["value"].isNull()), "not_a_map").when(F.size(entries) > MOST_HEADERS, "too_many").otherwise(first)


def clean_headers(headers: Column) -> Column:
    """JS3: names in lower case, values without blanks around them; NULL for headers that are refused."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    return F.when(headers_error(headers).isNull(), F.map_from_entries(entries))


def header_names(headers: Column) -> Column:
    """JS4: names in lower case, in order; an empty array for no map or a refused one."""
    return F.coalesce(F.array_sort(F.map_keys(clean_headers(headers))), F.array().cast("array<string>"))


def strict_base64(value: Column) -> Column:
    """JS5: the bytes of well-formed base64; NULL for another alphabet, blanks or missing padding."""
    well = value.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(well, F.try_to_binary(value, F.lit("base64")))


def request_fingerprint(*columns: str) -> Column:
    """HS2: the digest of a request's fields as JSON in order of their names; absent ones are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def normalized_rect(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """AR3: a rectangle in fractions of its page, cut at the edges; NULL if nothing is left."""
    unit = lambda v, whole: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / whole))
    left, top, right, bottom = unit(x, page_width), unit(y, page_height), unit(x + width, page_width), unit(y + height, page_height)
    whole = (page_width > 0) & (page_height > 0) & (right > left) & (bottom > top)
    return F.when(whole, F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height")))


def matrix_product(a: Column, b: Column) -> Column:
    """AR5: two affine matrices (a, b, c, d, e, f) of arrays, a applied first."""
    g = F.get
    cell = lambda i, j: g(a, i) * g(b, j) + g(a, i + 1) * g(b, j + 2)
    return F.array(cell(0, 0), cell(0, 1), cell(2, 0), cell(2, 1), cell(4, 0) + g(b, 4), cell(4, 1) + g(b, 5))


def page_number(value: Column, current: Column, pages: Column) -> Column:
    """STR25: a typed decimal number without its fraction, taken into the pages there are; other input keeps the current page."""
    typed = F.regexp_extract(value, r"\A\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*\z", 1)
    n = F.nullif(typed, F.lit("")).cast("double")
    return F.when(n.isNull() | (F.abs(n) == float("inf")), current).otherwise(F.greatest(F.lit(1.0), F.least(n, pages.cast("double")))).cast("int")


def zoom(value: Column, wheel: Column, low: float = 0.5, high: float = 2.5) -> Column:
    """STR25: a zoom after a turn of the wheel, within its limits."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value * F.exp(-wheel / 1000.0)))


def message(template: Column, values: Column, plurals: str = "pages|paragraphs|tasks") -> Column:
    """STR26: a template with each {name} replaced once by the value of a map; unknown names stay.

    With a count of 1 the template's plurals lose their last letter; None leaves them.
    """
    single = reduce(lambda t, p: F.regexp_replace(t, rf"\b{p}\b", p[:-1]), plurals.split("|") if plurals else (), template)
    text = F.when(F.try_element_at(values, F.lit("count")) == "1", single).otherwise(template)
    names = F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1))
    filled = F.transform(names, lambda n: F.coalesce(F.try_element_at(values, n), F.concat(F.lit("{"), n, F.lit("}"))))
    return F.array_join(F.transform(F.split(text, r"\{\w+\}"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(filled, i - 1), p))), "")


def record_ids(values: Column, extra: Column) -> Column:
    """STR4, FP13: distinct ids in the fields of a record; with one base, also the versions that lines of extra name for it."""
    ids = F.array_distinct(F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), references)))
    bases = F.array_distinct(F.transform(ids, base_id))
    versions = F.regexp_extract_all(F.coalesce(extra, F.lit("")), F.lit(r"(?im)^\s*version\s*:\s*v?([1-9][0-9]*)\s*$"), F.lit(1))
    named = F.transform(versions, lambda v: F.concat(F.get(bases, 0), F.lit("v"), v))
    return F.when(F.size(bases) == 1, F.array_distinct(F.concat(ids, named))).otherwise(ids)


STAMP = r"(?i)arxiv\s*:\s*((?:[0-9]{4}\s*\.\s*[0-9]{4,5}|[a-z][a-z.\-]+\s*/\s*[0-9]{7})\s*v\s*[1-9][0-9]*)(?!\w)\s*(\[[a-z][a-z.\-]*(?:\.[a-z]+)?\])?"  # a fixed pattern


def page_stamp(text: Column, base: Column) -> Column:
    """STR5: (id, error) of a page's stamps; those with a category in brackets count before all others, of which only the base's count.

    The error is id_conflict for several bases or another one than base, and version_ambiguous for several versions; NULL base expects none.
    """
    group = lambda n: F.regexp_extract_all(text, F.lit(STAMP), F.lit(n))
    stamps = F.arrays_zip(F.transform(group(1), lambda i: F.regexp_replace(i, r"\s+", "")).alias("id"), group(2).alias("mark"))
    strong = F.filter(stamps, lambda s: s["mark"] != "")
    weak = F.filter(stamps, lambda s: F.coalesce(base_id(s["id"]) == base, F.lit(False)))
    ids = F.transform(F.when(F.size(strong) > 0, strong).otherwise(weak), lambda s: s["id"])
    bases, versions = F.array_distinct(F.transform(ids, base_id)), F.array_distinct(ids)
    error = F.when((F.size(bases) > 1) | ((F.size(bases) == 1) & F.coalesce(F.get(bases, 0) != base, F.lit(False)) & (F.size(versions) == 1)), "id_conflict").when(F.size(versions) > 1, "version_ambiguous")
    return F.struct(F.when(error.isNull(), F.get(versions, 0)).alias("id"), error.alias("error"))


def stamp_version(text: Column, base: Column) -> Column:
    """STR5: the id that a page's stamps agree on; NULL if there is none or a conflict."""
    return page_stamp(text, base)["id"]


def url_error(url: Column) -> Column:
    """VL8: why an address of a service is refused, or NULL."""
    return F.when(~F.coalesce(url.rlike(r"^https?://[^/?#\s]+"), F.lit(False)), "invalid_url").when(url.rlike(r"^https?://[^/?#]*@"), "credentials_in_url").when(url.rlike(r"[?#]"), "query_in_url")


def upload_error(name: Column, size: Column) -> Column:
    """VL7: why an upload is refused, or NULL."""
    known = F.lower(name).rlike(r"\.(?:tex|zip|tar|tgz|gz|tar\.gz)$")
    return F.when(~F.coalesce(known, F.lit(False)), "unsupported_type").when(~F.coalesce(size > 0, F.lit(False)), "empty").when(size > 80_000_000, "too_large")


def annotation_error(page: Column, pages: Column, version: Column, current: Column, rects: Column) -> Column:
    """VL6: why an annotation is refused, or NULL; a page takes 1 to 300 rectangles."""
    inside = lambda r: r["x"].between(0, 1) & r["y"].between(0, 1) & (r["width"] > 0) & (r["height"] > 0) & (r["width"] <= 1) & (r["height"] <= 1) & (r["x"] + r["width"] <= 1.00001) & (r["y"] + r["height"] <= 1.00001)
    return F.when(~version.eqNullSafe(current), "version_changed").when(~F.coalesce(page.between(1, pages), F.lit(False)), "no_such_page").when(~F.coalesce(F.size(rects).between(1, 300) & F.forall(rects, inside), F.lit(False)), "out_of_bounds")


def same_artifact(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = ("task_id", "artifact", "language", "arxiv_id")) -> Column:
    """FP10: equality of two notes, absent fields being equal to absent ones."""
    return reduce(lambda x, y: x & y, [a[f].eqNullSafe(b[f]) for f in fields])


def parent_status(children: DataFrame) -> DataFrame:
    """AG10: per parent: untranslated, translated or review, from (parent_id, paper_id, kind, warned); kind is original or translation.

    A parent is translated if each version among its originals has a translation without warnings.
    """
    translated = F.collect_set(F.when((F.col("kind") == "translation") & ~F.col("warned"), F.col("paper_id")))
    originals = F.collect_set(F.when(F.col("kind") == "original", F.col("paper_id")))
    g = children.groupBy("parent_id").agg(originals.alias("o"), translated.alias("t"), F.bool_or((F.col("kind") == "translation")).alias("any"))
    missing = F.array_sort(F.array_except("o", "t"))
    status = F.when(~F.col("any"), "untranslated").when(F.size(missing) == 0, "translated").otherwise("review")
    return g.select("parent_id", status.alias("status"), missing.alias("uncovered"))


def evidence(rows: DataFrame, key: str, paper_id: str) -> DataFrame:
    """AG11, FP12, RK7: per key the only base and version that its evidence names, and whether it conflicts."""
    base = F.regexp_replace(F.lower(paper_id), r"v[0-9]+$", "")
    g = rows.groupBy(key).agg(F.min(base).alias("base"), F.max(base).alias("_b"), F.min(F.when(F.col(paper_id).rlike(r"v[0-9]+$"), F.lower(paper_id))).alias("version"), F.max(F.when(F.col(paper_id).rlike(r"v[0-9]+$"), F.lower(paper_id))).alias("_v"))
    conflict = F.coalesce((F.col("base") != F.col("_b")) | (F.col("version") != F.col("_v")), F.lit(False))
    return g.select(key, F.when(~conflict, F.col("base")).alias("base"), F.when(~conflict, F.col("version")).alias("version"), conflict.alias("conflict"))


def audit(segments: DataFrame) -> DataFrame:
    """AG12: counts over (source, masked, output, error): segments, validated, refused, markers left in, CJK letters."""
    return segments.agg(F.count("*").alias("segments"), F.count_if(F.col("error").isNull() & F.col("output").isNotNull()).alias("validated"), F.count_if(F.col("error").isNotNull()).alias("refused"), F.count_if(F.contains("output", F.lit("⟪"))).alias("leaks"), F.sum(F.regexp_count("output", F.lit("[\\x{3400}-\\x{9fff}]"))).alias("cjk"))


def header_draft(previous: Column, following: Column, draft: Column) -> Column:
    """STR27: a draft of headers stays with its endpoint; another address starts with none."""
    from texloom.functions.text import endpoint

    return F.when(endpoint(previous) == endpoint(following), draft).otherwise(F.lit(""))


def local_markers(masked: Column) -> Column:
    """MP1: (masked, originals): a piece whose markers are numbered from 0, and the marker that each number stands for."""
    found = F.regexp_extract_all(masked, F.lit("(⟪P[0-9]{4,}⟫)"), F.lit(1))
    parts = F.split(masked, "⟪P[0-9]{4,}⟫")
    local = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.format_string("⟪P%04d⟫", i - 1), p)))
    return F.struct(F.array_join(local, "").alias("masked"), found.alias("originals"))


def global_markers(masked: Column, originals: Column) -> Column:
    """MP1: the inverse: local numbers, in any order, back to the markers they stand for; unknown numbers stay."""
    numbers = F.regexp_extract_all(masked, F.lit("⟪P([0-9]{4,})⟫"), F.lit(1))
    parts = F.split(masked, "⟪P[0-9]{4,}⟫")
    back = lambda i: F.coalesce(F.get(originals, F.get(numbers, i).cast("int")), F.concat(F.lit("⟪P"), F.get(numbers, i), F.lit("⟫")))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(back(i - 1), p))), "")


# How services say that a request may only have the default temperature.
ONLY_DEFAULT_TEMPERATURE = (
    r"\btemperature\b.{0,100}(?:not supported|not allowed|unsupported|only\b.{0,60}\b(?:default|1)\b|must (?:be|equal)\b.{0,40}\b1\b)"
    r"|(?:does not support|unsupported)\s+(?:the\s+)?[\"']?temperature\b|only supports?\s+temperature\s*(?:=|of|:)\s*1\b"
)


def default_temperature_required(kind: Column, param: Column, code: Column, message: Column) -> Column:
    """EX8: whether an error asks for the request again without its temperature."""
    plain = (param == "temperature") & code.isin("unsupported_parameter", "unsupported_value")
    said = (kind == "invalid_request_error") & F.lower(message).rlike(ONLY_DEFAULT_TEMPERATURE)
    return F.coalesce(plain, F.lit(False)) | F.coalesce(said, F.lit(False))


def captured_view(pages: Column, top: Column, height: Column) -> Column:
    """AR6: (page, fraction, viewport) at a fifth of the view, from pages (page, top, height) in order; NULL without pages or height."""
    focus = top + height * 0.2
    page = F.coalesce(F.get(F.filter(pages, lambda p: p["top"] <= focus), F.size(F.filter(pages, lambda p: p["top"] <= focus)) - 1), F.get(pages, 0))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    point = F.greatest(page["top"], F.least(page["top"] + page["height"], focus))
    view = F.struct(page["page"].alias("page"), unit((point - page["top"]) / page["height"]).alias("fraction"), unit((point - top) / height).alias("viewport"))
    return F.when((F.size(pages) > 0) & (height > 0), view)


def scroll_offset(page: Column, position: Column, height: Column) -> Column:
    """AR6: where to scroll for a position (page, fraction, viewport) on its page (page, top, height); the very start is 0."""
    viewport = F.coalesce(position["viewport"], F.lit(0.0))
    start = (position["page"] == 1) & (position["fraction"] == 0) & (viewport == 0)
    fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position["fraction"]))
    return F.when(start, F.lit(0.0)).otherwise(page["top"] + fraction * page["height"] - viewport * height)


def artwork_signature(subtype: Column, stream: Column, metadata: Column, stored: Column) -> Column:
    """HS3: a form by its drawing commands, another object by its sorted metadata (without its length) and stored bytes."""
    entries = F.array_sort(F.map_entries(F.map_filter(metadata, lambda k, v: k != "/Length")))
    return F.when(subtype == "/Form", F.sha2(stream, 256)).otherwise(F.sha2(F.concat(F.to_json(entries).cast("binary"), stored), 256))


def backoff(attempt: Column, jitter: Column) -> Column:
    """DT2: seconds to wait before the next attempt (from 0), with a jitter that the caller draws."""
    return F.pow(F.lit(2.0), attempt + 1) + jitter
