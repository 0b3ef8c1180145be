"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = r"⟪P[0-9]{4,}⟫"
HIDDEN = "[hidden]"

# The words and headings that tell English prose.
PROSE_WORDS = ("the", "is", "are", "and", "of", "with", "for", "to", "we", "this", "our", "these", "from", "by", "that", "in")
HEADINGS = ("introduction", "conclusion", "conclusions", "discussion", "abstract", "results", "methods", "background", "acknowledgements", "limitations")

# Hosts of translation services.
SERVICE_HOSTS = {"api.deepl.com": "deepl", "api-free.deepl.com": "deepl", "api.deepseek.com": "deepseek", "dashscope.aliyuncs.com": "qwen", "dashscope-intl.aliyuncs.com": "qwen", "dashscope-us.aliyuncs.com": "qwen"}
SERVICE_REGIONS = r"^[a-z0-9-]+\.(?:cn-beijing|ap-southeast-1|ap-northeast-1|eu-central-1|cn-hongkong)\.maas\.aliyuncs\.com$"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":[0-9]*$", ""))


def service(url: Column) -> Column:
    """STR6: which service an address belongs to."""
    host = url_host(url)
    known = reduce(lambda c, kv: c.when(host == kv[0], kv[1]), SERVICE_HOSTS.items(), F.when(host.rlike(SERVICE_REGIONS), "qwen"))
    return known.otherwise("custom")


def endpoint(url: Column, host_of: dict[str, str] | None = None) -> Column:
    """STR6: an official chat address in its normal form; other addresses as they are."""
    hosts = list(host_of or {"api.openai.com": "openai", "api.anthropic.com": "anthropic"})
    direct = url.rlike(r"^https://[^/?#@:]+(?::443)?(?:/[^?#]*)?$") & url_host(url).isin(*hosts)
    path = F.regexp_replace(F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1), r"/+$", "")
    usual = path.isin("", "/v1", "/chat/completions", "/v1/chat/completions")
    return F.when(direct & usual, F.concat(F.lit("https://"), url_host(url), F.lit("/v1"))).otherwise(url)


def redact(text: Column, secrets: list[str] = ()) -> Column:
    """STR7: secrets, longest first, and keys of the form sk-... are hidden."""
    import re

    for s in sorted({s for s in secrets if s}, key=len, reverse=True):
        text = F.regexp_replace(text, re.escape(s).replace("/", r"\/"), HIDDEN)
    return F.regexp_replace(text, r"sk-[A-Za-z0-9._\-]+", HIDDEN)


def error_detail(text: Column, secrets: list[str] = (), limit: int = 500) -> Column:
    """STR8: redacted, bearer tokens hidden, blanks collapsed, cut after limit characters."""
    out = F.regexp_replace(redact(text, secrets), r"(?i)\bBearer\s+[A-Za-z0-9._~+/=\-]+", "Bearer " + HIDDEN)
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("…"))).otherwise(out)


def limit_context(text: Column, limit: int = 6000) -> Column:
    """STR15: at most limit characters, ending with a sentence, else with a word, if one ends late enough."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    prefix = F.substring(t, 1, limit - 1)
    # the last sentence end: what follows it holds none
    to_sentence = F.regexp_extract(prefix, r"(?s)^(.*(?:[.!?](?=\s|$)|[。！？]))", 1)
    last_blank = F.length(prefix) - F.locate(" ", F.reverse(prefix))
    at_word = F.when((F.locate(" ", prefix) > 0) & (last_blank >= limit * 0.8), F.substr(prefix, F.lit(1), last_blank)).otherwise(prefix)
    cut = F.when((F.length(to_sentence) > 0) & (F.length(to_sentence) - 1 >= limit * 0.7), to_sentence).otherwise(at_word)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def normalize_generated(text: Column) -> Column:
    r"""STR17: literal \n and \t become blanks of their kind, blank lines one space."""
    t = F.regexp_replace(text, r"\\n(?=[^A-Za-z]|$)", "\n")
    t = F.regexp_replace(t, r"\\t(?=[^A-Za-z]|$)", "\t")
    return F.regexp_replace(t, r"\n[ \t\r]*\n(?:[ \t\r]*\n)*", " ")


def generated_error(text: Column) -> Column:
    """VL1: why generated prose is refused, or NULL."""
    return (
        F.when(F.contains(text, F.lit("\\")) | text.rlike(r"\$[^$]+\$"), "extra_command")
        .when(F.contains(text, F.lit("⟪")) | F.contains(text, F.lit("⟫")) | F.contains(text, F.lit("```")), "invalid_format")
    )


REASONING = "think|thinking|reasoning|analysis"


def without_reasoning(text: Column, depth: int = 8) -> Column:
    """STR14: (value, error) of an answer without its reasoning: what stands outside all tags, or "ambiguous" for tags that do not balance."""
    tag = rf"<(/?(?:{REASONING}))\b[^>]*>"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?is).*?(?:{tag}|\z)"), F.lit(0))
    state = lambda out, names, bad: F.struct(out.alias("out"), names.cast("array<string>").alias("names"), bad.alias("bad"))

    def step(s: Column, piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, rf"(?is){tag}\z", 1))
        out = F.when(F.size(s["names"]) == 0, F.concat(s["out"], F.regexp_replace(piece, rf"(?is){tag}\z", ""))).otherwise(s["out"])
        closes = name.startswith("/")
        names = F.when(closes, F.slice(s["names"], 1, F.greatest(F.size(s["names"]) - 1, F.lit(0)))).when(name != "", F.concat(s["names"], F.array(name))).otherwise(s["names"])
        fits = F.coalesce(F.get(s["names"], F.size(s["names"]) - 1) == F.substring(name, 2, 16), F.lit(False))
        return state(out, names, s["bad"] | (closes & ~fits) | (F.size(names) > depth))

    def end(s: Column) -> Column:
        bad = s["bad"] | (F.size(s["names"]) > 0)
        plain = F.regexp_replace(s["out"], r"(?U)^\s+|\s+$", "")
        return F.struct(F.when(~bad, plain).alias("value"), F.when(bad, F.lit("ambiguous")).alias("error"))

    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("error"))
    return F.when(text.isNotNull(), F.aggregate(pieces, state(F.lit(""), F.array(), F.lit(False)), step, end)).otherwise(none)


def slot_reasons(slots: Column, output: Column) -> Column:
    """VL5: for each slot asked for (a map of names to sources) why its answer in the output is refused, null for one that is taken.

    NULL for an output that is no JSON object or holds slots that were not asked for.  A fence around the JSON is taken off.
    """
    plain = F.regexp_replace(output, r"(?s)\A```(?:json)?\s*\n(.*?)\n```\z", "$1")
    given = F.from_json(plain, "map<string,variant>")
    fits = given.isNotNull() & (F.size(F.array_except(F.map_keys(given), F.map_keys(slots))) == 0)

    def reason(name: Column, source: Column) -> Column:
        value = F.try_element_at(given, name)
        said = F.try_variant_get(value, "$", "string")
        bare = without_reasoning(said)
        kept = F.coalesce(bare["value"], said)
        return (
            F.when(~F.array_contains(F.map_keys(given), name), "missing").when(value.isNull() | (F.schema_of_variant(value) != "STRING"), "not_a_string")
            .when(bare["error"].isNotNull(), "invalid_response_envelope").when(kept.rlike(r"(?U)\A\s*\z") & source.rlike(r"(?U)\S"), "empty_text")
            .when(kept.rlike("[⟪⟫]"), "protected_token").when(F.contains(kept, F.lit("\\")) | F.contains(kept, F.lit("```")) | kept.rlike(r"\$[^$]+\$"), "invalid_syntax")
        )

    return F.when(fits, F.transform_values(slots, reason))


def is_prose(text: Column) -> Column:
    """VL2: eight words or more, two of them common ones."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, MARKER, "")), F.lit("([a-z]{2,})"), F.lit(1))
    common = F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, PROSE_WORDS)))
    return (F.size(words) >= 8) & (F.size(common) >= 2)


def language_error(source: Column, output: Column, language: Column) -> Column:
    """VL2: why an output is not in the Chinese that was asked for, or NULL."""
    source, output = F.regexp_replace(source, MARKER, ""), F.regexp_replace(output, MARKER, "")
    words = F.regexp_count(source, F.lit("[A-Za-z]{2,}"))
    left = F.regexp_count(output, F.lit("[A-Za-z]{2,}"))
    cjk = F.regexp_count(output, F.lit("[\\x{3400}-\\x{9fff}]"))
    heading = F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")).isin(*HEADINGS)
    prose = is_prose(source)
    found = F.when((prose | heading) & (cjk == 0), "not_translated").when(prose & (left > words * 0.8) & (cjk < words * 0.15), "mostly_source")
    return F.when(language.isin("zh-hans", "zh-hant"), found)


def file_stem(name: Column, limit: int = 72) -> Column:
    """STR22: a name that is safe for a file; paper if nothing is left of it."""
    stem = F.substring(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w.\-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, limit)
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("paper"))


def progress(done: Column, total: Column) -> Column:
    """STR23: percent of a job while texts are translated."""
    return F.when(total > 0, (25 + F.floor(60 * done / total)).cast("int")).otherwise(F.lit(25))


def retry_delay(header: Column, now: Column, fallback: Column) -> Column:
    """DT1: seconds to wait after a Retry-After header of seconds or a date, at least fallback; fallback for any other header."""
    number = F.when(header.rlike(r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"), header.try_cast("double"))
    day = F.regexp_replace(header, r"^[A-Za-z]{3}, ", "")
    date = F.try_to_timestamp(day, F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = F.coalesce(number, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when((wait >= 0) & (wait < float("inf")), F.greatest(wait, fallback)).otherwise(fallback)


def clamp(x: Column, low=0.0, high=1.0) -> Column:
    """AR1."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_path(name: Column) -> Column:
    """SC4: a relative path that stays below its root."""
    n = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.split(n, "/")
    return ~(n.startswith("/") | F.exists(parts, lambda p: (p == "..") | F.contains(p, F.lit(":"))) | F.contains(n, F.lit("\0")))


def windows_path(name: Column) -> Column:
    """SC5: a path whose parts Windows can hold."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    stem = lambda p: F.rtrim(F.element_at(F.split(p, r"\."), 1))
    return F.forall(parts, lambda p: ~p.rlike(r'[<>:"|?*\x00-\x1f]') & ~p.rlike(r"[ .]$") & ~stem(p).rlike(r"(?i)^(CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])$"))
