"""URL rules in Bloom filter cascades.

A rule is a key ``host/path``; it fits its host and all subdomains if the url's path
starts with the rule's path, and of the rules that fit the longest wins.  Block keys and
allow keys have a cascade each.  Level 0 of one holds its listed keys; level 1 those keys
of the corpus's complete key universe that level 0 takes for listed; level 2 the listed
keys that level 1 holds wrongly, and so on until a level errs on no key.  A key's
membership is then exact for every key of the corpus, and no url is joined with anything:
the workers get the two cascades alone, which say whether a key is a rule and of which kind.

The universe is all pairs of a host's label suffixes, of the numbers of labels that rules
have, with the path prefixes of the lengths that rules have, made by SQL functions and written once to the shared folder as
64-bit hashes.  Level 0 is sized so that it errs on about as many keys as are listed.  A
level's bits are set on the executors and reach the driver as a filter, never as keys, so
what the driver holds grows with the rules alone, and there is no bound on errors.

Defined results.  A null url, or one without ``://``, has an empty host and path and no
rule; urls that no rule fits have the verdict ``default``.  Repeated rows are judged
each.  Other columns are ignored.  A key listed as both allow and block is an error.
Keys are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import cut, discard, ints, packed
from llm.textkernel import mix

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
KINDS = ("allow", "block")


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def keys(host: Column, path: Column, lengths: tuple[int, ...], labels: tuple[int, ...]) -> Column:
    """The keys under which a url may be listed, longest first (array of strings).

    Only suffixes of as many labels as some rule has are made, or the whole of a shorter host, so
    that a host of any number of labels gives as many keys as a short one.
    """
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in labels]))
    tails = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    found = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(tails, lambda t: F.concat(s, t)))))
    ordered = F.transform(F.array_sort(F.transform(found, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda x: x["k"])
    return F.when(host != "", ordered).otherwise(F.array().cast("array<string>"))


class Level:
    """A Bloom filter of a given rate; its bits are set from hashes or taken as they are."""

    def __init__(self, many: int, rate: float, salt: int):
        self.size = 8 * max(8, math.ceil(many * -math.log(rate) / math.log(2) ** 2 / 8))
        self.probes, self.salt = max(1, round(-math.log2(rate))), salt
        self.bits = np.zeros(self.size // 8, np.uint8)

    def places(self, hashes: np.ndarray):
        for i in range(self.probes):
            yield (mix(hashes + np.uint64((self.salt * 64 + i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(self.size)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> "Level":
        for at in self.places(hashes):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return self

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


class Cascade:
    def __init__(self):
        self.levels: list[Level] = []

    def depth(self, hashes: np.ndarray) -> np.ndarray:
        """How many levels in a row hold each key."""
        out = np.zeros(len(hashes), np.int64)
        alive = np.arange(len(hashes))
        for level in self.levels:
            alive = alive[level.has(hashes[alive])]
            out[alive] += 1
        return out

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.depth(hashes) % 2 == 1


SEGMENT = 1 << 20


def _filled(level: Level, rows: DataFrame) -> Level:
    """The level with the keys of rows (one column, key); executors set its bits, segment by segment."""

    def fill(batches):
        own = Level(1, 0.5, level.salt)
        own.size, own.probes, own.bits = level.size, level.probes, np.zeros(len(level.bits), np.uint8)
        for batch in batches:
            own.add(ints(batch.column(0)).view(np.uint64))
        parts = [(at, own.bits[at : at + SEGMENT]) for at in range(0, len(own.bits), SEGMENT)]
        parts = [(at, x.tobytes()) for at, x in parts if x.any()]
        if parts:
            yield packed(pa.schema([("at", pa.int64()), ("blob", pa.binary())]), parts)

    def join(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(blob, np.uint8)
                held[at] = held[at] | x if at in held else x
        if held:
            yield packed(pa.schema([("at", pa.int64()), ("blob", pa.binary())]), [(at, x.tobytes()) for at, x in held.items()])

    shape = "at long, blob binary"
    for at, blob in rows.mapInArrow(fill, shape).repartition("at").mapInArrow(join, shape).collect():
        level.bits[at : at + len(blob)] |= np.frombuffer(blob, np.uint8)
    return level


def _build(universe: DataFrame, size: int, listed: np.ndarray) -> Cascade:
    """The cascade of one list of keys (hashes) over the universe (one column, key), of about size keys."""
    out = Cascade()
    if not len(listed):
        return out
    rate = min(0.5, max(1e-9, len(listed) / (math.sqrt(2) * max(1, size))))
    out.levels.append(Level(len(listed), rate, 0).add(listed))
    own, wrong = set(listed.tolist()), universe

    def still(levels):
        def test(batches):
            for batch in batches:
                h = ints(batch.column(0)).view(np.uint64)
                for level in levels:
                    h = h[level.has(h)]
                h = np.array([x for x in h.tolist() if x not in own], np.uint64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

        return test

    while True:
        # all that err on the levels so far are among those that erred on the levels before
        last, wrong = wrong, cut(wrong.mapInArrow(still(out.levels[-2:]), "key long"), "url-errors")
        if last is not universe:
            discard(last)
        many = wrong.count()
        if many:
            out.levels.append(_filled(Level(many, 0.5, len(out.levels)), wrong))
            over = listed[out.depth(listed) == len(out.levels)]
            if len(over):
                out.levels.append(Level(len(over), 0.5, len(out.levels)).add(over))
                continue
        discard(wrong)
        return out


def build(urls: DataFrame, rules=RULES) -> dict[str, Cascade]:
    """Cascades by kind that tell the kind's keys from all other keys of urls (one column, url)."""
    spark = urls.sparkSession
    if len({h + p for h, p, _ in rules}) < len({(h + p, v) for h, p, v in rules}) or {v for *_, v in rules} - set(KINDS):
        raise ValueError("a key has one verdict, allow or block")
    if not rules:
        return {kind: Cascade() for kind in KINDS}
    hashes = spark.createDataFrame([(h + p, v) for h, p, v in rules], "k string, v string").select(F.xxhash64("k"), "v").collect()
    host, path = parse(F.col("url"))
    found = urls.select(host.alias("host"), path.alias("path")).distinct().select(F.explode(keys(F.col("host"), F.col("path"), _lengths(rules), _labels(rules))).alias("k")).select(F.xxhash64("k").alias("key")).distinct()
    universe = cut(found, "url-universe")
    size = universe.count()
    out = {kind: _build(universe, size, np.array(sorted({r[0] for r in hashes if r[1] == kind}), np.int64).view(np.uint64)) for kind in KINDS}
    discard(universe)
    return out


def _lengths(rules) -> tuple[int, ...]:
    return tuple(sorted({len(p) for _, p, _ in rules}))


def _labels(rules) -> tuple[int, ...]:
    return tuple(sorted({h.count(".") + 1 for h, *_ in rules}))


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url)."""
    spark = pages.sparkSession
    host, path = parse(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    cascades = spark.sparkContext.broadcast(build(pages.select("url"), rules))
    rows = rows.withColumn("keys", keys(F.col("host"), F.col("path"), _lengths(rules), _labels(rules)))
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))])

    def apply(batches):
        for batch in batches:
            at = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))))
            names, h = batch.column(3).flatten(), ints(batch.column(4).flatten()).view(np.uint64)
            kind = np.select([c.has(h) for c in map(cascades.value.get, KINDS)], range(len(KINDS)), -1)
            # the first key of a row that a cascade holds
            hit = np.flatnonzero(kind >= 0)
            row = np.searchsorted(at, hit, side="right") - 1
            row, first = np.unique(row, return_index=True)
            rule, verdict = np.full(batch.num_rows, None, object), np.full(batch.num_rows, default, object)
            rule[row] = np.array(names.take(pa.array(hit[first])).to_pylist(), object)
            verdict[row] = np.array(KINDS, object)[kind[hit[first]]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    hashed = rows.select("*", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes"))
    return hashed.mapInArrow(apply, "page_id long, host string, path string, rule string, verdict string")
