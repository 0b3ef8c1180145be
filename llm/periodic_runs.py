"""Runs of periodic words: stretches that repeat themselves, found by bit-parallel lags.

A run is a stretch of words with smallest period q, of at least ``least`` words and
``times * q``, that no neighbouring word extends keeping that period.  All texts of a
chunk are numbered word by word and laid one after the other, a number of its own between
any two.  Bit k of all numbers is one big integer, a plane.  For a lag q each plane is
compared with itself moved by q (XOR), the differences are joined (OR), and ANDs of the
matches with themselves, moved by doubled steps, leave the places where enough matches
follow each other.  Texts of like length share a chunk's integers, so a short text is
never compared at the lags of a long one.

Lags up to EVERY are all tried.  A longer lag q, with g the power of two from q up to 2q,
is tried where it can hold a run: in a run of period q at least q places are followed
by the same g words exactly q later and not sooner, as no rotation of a primitive word
lies inside its square.  Those places are counted from the sorted hashes of all g-word
windows, so a text of n words is compared at about 2n/q lags near q, not at all n/times.

The words between two texts cannot be passed: a match across one would need the number
that stands there once only, and the places between it and the lag before it are fewer
than a run takes.  A stretch that is found at several lags has the smallest of them as its
period (the others are its multiples, by Fine and Wilf).

No exchange is needed.  Defined results.  A null or empty text has no words and no runs;
repeated rows are judged each; a null doc_id is returned as it is.  Texts are read whole;
a task holds one chunk of CHUNK_BYTES, or one text where that is longer.  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_batches, chunks, ranges
from llm.textkernel import mix, text_bytes

CHUNK_BYTES = 4 << 20
EVERY = 1024
SPACE = r"[\x20\x09-\x0D]+"
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _plane(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _stretches(found: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of ones."""
    bits = np.unpackbits(np.frombuffer(found.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little").astype(np.int8)
    step = np.diff(np.concatenate(([0], bits, [0])).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def _enough(x: int, m: int) -> int:
    """Ones where m ones in a row start."""
    held = 1
    while held < m and x:
        step = min(held, m - held)
        x &= x >> step
        held += step
    return x


def _long_lags(ids: np.ndarray, top: int, every: int) -> list[int]:
    """Lags above every, up to top, at which a run is possible."""
    out: list[int] = []
    h, size = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while size < top:
        h = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
        if size <= every:
            continue
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        gap = (order[1:] - order[:-1])[same]
        gap = gap[(gap > max(every, size // 2)) & (gap <= min(size, top))]
        if len(gap):
            lags, seen = np.unique(gap, return_counts=True)
            out += lags[seen * 2 >= lags].tolist()
    return sorted(out)


def runs_of(ids: np.ndarray, longest: int, least: int = 6, times: int = 4, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs among numbered words; texts of at most longest words are parted by numbers used once."""
    n, top = len(ids), longest // times
    planes = [_plane((ids >> k) & 1) for k in range(max(1, int(ids.max()).bit_length()))] if n else []
    parts = []
    for q in [*range(1, min(top, every) + 1), *_long_lags(ids, top, every)]:
        if n <= q:
            break
        m = max(least - q, (times - 1) * q)
        whole = (1 << (n - q)) - 1
        differ, found = 0, 0
        for at in range(0, len(planes), 4):
            for p in planes[at : at + 4]:
                differ |= p ^ (p >> q)
            found = _enough(~differ & whole, m)
            if not found:
                break
        if found:
            first, last = _stretches(found, n)
            parts.append((first, last - first + m + q, np.full(len(first), q, np.int64)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, length, period = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _chunk(texts: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """For each text an array of (start, length, period) rows."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    by_size = defaultdict(list)
    for i, words in enumerate(texts):
        if len(words) >= least:
            by_size[len(words).bit_length()].append(i)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    for members in by_size.values():
        pieces = [np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i])) for i in members]
        at = np.cumsum([0] + [len(p) + 1 for p in pieces])
        ids = np.empty(at[-1], np.int64)
        for a, p in zip(at, pieces):
            ids[a : a + len(p)] = p
        ids[at[1:] - 1] = np.arange(len(members)) + len(number)  # used once: higher than any word's
        start, length, period = runs_of(ids, max(map(len, pieces)), least, times)
        cut = np.searchsorted(start, at)
        for j, i in enumerate(members):
            if cut[j + 1] > cut[j]:
                s = slice(cut[j], cut[j + 1])
                out[i] = np.stack((start[s] - at[j], length[s], period[s]), axis=1)
    return out


def find(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed).

    collapsed is the text's words without those that a run holds after its first period,
    joined by single blanks.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def work(batches):
        for batch in chunks(batches, "text", CHUNK_BYTES):
            data, offs = text_bytes(batch.column(1))
            raw = data.tobytes()
            texts = [raw[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            found = _chunk(texts, least, times)
            kept = []
            for words, r in zip(texts, found):
                if len(r):
                    stay = np.ones(len(words), bool)
                    stay[ranges(r[:, 0] + r[:, 2], r[:, 1] - r[:, 2])] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                kept.append(b" ".join(words))
            counts = np.array([len(r) for r in found], np.int32)
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in texts], pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a run planted in the texts whose crc32 of doc_id ends in the digit 0.

    From a place on, their words repeat the p words that stand there; a null id plants nothing.
    """
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    words = F.filter(F.split(docs["text"].cast("string"), SPACE), lambda x: x != "")
    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"), F.when(h % 10 == 0, words).alias("_w"), F.floor(h / 10).cast("long").alias("_g"))
    n = F.nullif(F.size("_w").cast("long"), F.lit(0))
    a = F.col("_g") % n
    rows = rows.select("doc_id", "text", "_w", F.when(n > 0, a).alias("_a"), F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("_g") % 8)).cast("long")).alias("_p"))

    def word(i: Column) -> Column:
        return F.get("_w", F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i).cast("int"))

    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row a document: its number of runs, the longest one, digests of all runs and of the collapsed text."""
    best = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))[0]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("_best.l"), F.col("_best.p")
    return rows.select("doc_id", "n_runs", F.col("_best.s").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
