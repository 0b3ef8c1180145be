"""Language-model scoring with a log-frequency Bloom filter.

Word and word-pair counts of the training documents are quantised to levels
``q = 1 + floor(log(count) / log(BASE))``.  The filter holds (n-gram, 1) ... (n-gram, q);
a count is read back by probing level after level until the first miss.  The score of
a token after another is ``(1 - W) p(word) + W p(word | previous)``, with ``p(word)``
smoothed by adding 0.1 to each count.  The filter has one segment per bucket, filled
and probed where the bucket's counts are made and as large as its entries ask for, so
that no n-gram is left out and no segment leaves its bucket.

Nothing but two sums for each bucket reaches the driver.  Each chunk sends its distinct
words and pairs to their buckets and its token numbers to a bucket of its own; there
the answers (exact word counts, levels of words and pairs) meet the tokens again by
a hash of the chunk.

Tokens: words of non-blank bytes, A-Z lower-cased, then one end token.  Training
documents are those whose crc32(doc_id as text) mod 10 is not 0.

Defined results.  A null text is an empty one: its only token is the end.  A null
doc_id counts as the empty text in crc32, so it is held out.  Repeated rows are scored
each.  With no training document N and V are 0 and every token has 0.1 / 0.1 = 1 as its
base probability.  Words are told apart by 64-bit hashes, pairs by 32 bits and bucket.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bucket_of, buckets, chunks, cut, ints, packed, release, to_buckets
from llm.textkernel import mix, scan_words, text_bytes

BASE = 1.5
W = 0.1
BITS_PER_ENTRY = 12
PROBES = 4
END = np.uint64(0x5851F42D4C957F2D)
_K = np.uint64(0xE7037ED1A0B428DB)
_PAIR = np.uint64(0x8EBC6AF09C88C6E3)
_NULL = -(2**63)


def _held(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == _NULL else str(i).encode()) % 10 == 0 for i in ids.tolist()], bool)


def _tokens(batch: pa.RecordBatch):
    """(doc_ids, held out, tokens with ends, offsets by row)."""
    data, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
    _, _, h, at = scan_words(data, offs, lower=True)
    ids = ints(batch.column(batch.schema.get_field_index("doc_id")), _NULL)
    rows = len(ids)
    tok = np.empty(len(h) + rows, np.uint64)
    tok[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(at))] = h
    tok[at[1:] + np.arange(rows)] = END
    return ids, _held(ids), tok, at + np.arange(rows + 1)


def _pairs(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[at[:-1]] = END
    return mix(prev * _PAIR + tok)


def _asked(tok: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs as bucket and 32 bits, sorted, and each token's place among them."""
    pair = _pairs(tok, at)
    return np.unique(bucket_of(pair, n).astype(np.uint64) << np.uint64(32) | pair & np.uint64(0xFFFFFFFF), return_inverse=True)


def _squeeze(x: np.ndarray) -> bytes:
    """An array as the number of its values and their bytes, plane by plane, in Zstandard."""
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), asbytes=True) if len(x) else b""


def _spread_out(blob: bytes, dtype: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype)
    wide = np.dtype(dtype).itemsize
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little") * wide, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(dtype).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted values as differences; np.cumsum in their own type gives them back."""
    return np.diff(x, prepend=x.dtype.type(0))


_SHAPE = "bucket int, kind string, chunk binary, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("chunk", *"abcd"))])


def levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


_BETWEEN = np.concatenate(([0.0], np.sqrt(np.maximum(1, np.ceil(BASE ** np.arange(0, 80) - 1e-9)) * np.maximum(1, np.ceil(BASE ** np.arange(1, 81) - 1e-9) - 1))))


class LogFrequencyFilter:
    """Segments of one Bloom filter; counts come from repeated membership probes."""

    def __init__(self, segments: dict[int, bytes], n: int):
        size = np.array([len(segments.get(b, b"\0")) * 8 for b in range(n)], np.uint64)
        self.n, self.size = n, size
        self.base = np.concatenate(([np.uint64(0)], np.cumsum(size)))[:-1].astype(np.uint64)
        self.bits = np.frombuffer(b"".join(segments.get(b, b"\0") for b in range(n)), np.uint8)

    def level(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        alive = np.arange(len(key))
        size, base = self.size[bucket], self.base[bucket]
        level = 1
        while len(alive):
            for i in range(PROBES):
                at = base[alive] + probe(key[alive], level, i) % size[alive]
                alive = alive[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                if not len(alive):
                    break
            out[alive] += 1
            level += 1
            if level > 79:
                break
        return out

    def count(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return _BETWEEN[self.level(key, bucket)]


def probe(key: np.ndarray, level: int, i: int) -> np.ndarray:
    return mix(key + np.uint64((level * 8 + i) * 0xD1342543DE82EF95 & (2**64 - 1)))


def pair_key(pair: np.ndarray) -> np.ndarray:
    return mix((pair & np.uint64(0xFFFFFFFF)) ^ _K)


def _fill(keys: np.ndarray, counts: np.ndarray, least_bits: int = 64) -> bytes:
    """A segment that holds all the n-grams, of BITS_PER_ENTRY to twice as many bits an entry, or least_bits."""
    q = levels(np.maximum(counts, 1))
    bits = max(64, least_bits)
    while bits < BITS_PER_ENTRY * int(q.sum()):
        bits *= 2
    out = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        k = keys[q >= level]
        for i in range(PROBES):
            out[(probe(k, level, i) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _home(chunk: bytes, n: int) -> int:
    return int.from_bytes(chunk[:4], "little") * n >> 32


def _gather(docs: DataFrame, n: int) -> DataFrame:
    def spread(batches):
        for batch in chunks(batches, "text"):
            ids, held, tok, at = _tokens(batch)
            many = np.diff(at)
            train = np.repeat(~held, many)
            u, inverse = np.unique(tok, return_inverse=True)
            words = np.bincount(inverse, weights=train, minlength=len(u)).astype(np.uint32)
            u_at = np.searchsorted(bucket_of(u, n), np.arange(n + 1))
            asked, place = _asked(tok, at, n)
            pairs = np.bincount(place, weights=train, minlength=len(asked)).astype(np.uint32)
            p_at = np.searchsorted(asked >> np.uint64(32), np.arange(n + 1))
            chunk = hashlib.blake2b(ids.tobytes() + at.tobytes() + tok.tobytes(), digest_size=16).digest()
            times = np.bincount(inverse, minlength=len(u)).astype(np.uint32)
            rank = np.empty(len(u), np.uint32)  # common words get small numbers
            rank[np.argsort(-times.astype(np.int64), kind="stable")] = np.arange(len(u))
            out = [(_home(chunk, n), "tokens", chunk, _squeeze(np.concatenate((ids, at))), _squeeze(_steps(u)), _squeeze(times), _squeeze(rank[inverse]))]
            for b in range(n):
                w, p = slice(u_at[b], u_at[b + 1]), slice(p_at[b], p_at[b + 1])
                if w.stop > w.start or p.stop > p.start:
                    out.append((b, "asked", chunk, *map(_squeeze, (_steps(u[w]), words[w], _steps(asked[p].astype(np.uint32)), pairs[p]))))
            yield packed(_SCHEMA, out)

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == "tokens":
                    yield packed(_SCHEMA, [row])
                else:
                    held.setdefault(row[0], []).append(row[2:])
        while held:
            b, rows = held.popitem()
            us, ps = ([np.cumsum(_spread_out(r[i], t), dtype=t) for r in rows] for i, t in ((1, np.uint64), (3, np.uint32)))
            word, w_in = np.unique(np.concatenate(us), return_inverse=True)
            count = np.bincount(w_in, weights=np.concatenate([_spread_out(r[2], np.uint32) for r in rows]), minlength=len(word)).astype(np.int64)
            pair, p_in = np.unique(np.concatenate(ps), return_inverse=True)
            many = np.bincount(p_in, weights=np.concatenate([_spread_out(r[4], np.uint32) for r in rows]), minlength=len(pair)).astype(np.int64)
            pair = pair_key(pair.astype(np.uint64))
            known, seen = count > 0, many > 0
            lf = LogFrequencyFilter({0: _fill(np.concatenate((word[known], pair[seen])), np.concatenate((count[known], many[seen])))}, 1)
            w_level, p_level = (lf.level(x, np.zeros(len(x), np.int32)).astype(np.uint8) for x in (word, pair))
            out, w, p = [(-1, "stats", None, np.array([count.sum(), known.sum()], np.int64).tobytes(), None, None, None)], 0, 0
            for r, x, y in zip(rows, us, ps):
                ws, qs = w_in[w : w + len(x)], p_in[p : p + len(y)]
                w, p = w + len(x), p + len(y)
                out.append((_home(r[0], n), "answer", r[0], *map(_squeeze, (count[ws], w_level[ws], p_level[qs])), b.to_bytes(4, "little")))
            yield packed(_SCHEMA, out)

    return to_buckets(docs.mapInArrow(spread, _SHAPE), n).mapInArrow(meet, _SHAPE)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    n = buckets(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gathered = cut(_gather(docs, n), "lm-counts")
    release(spark)
    stats = np.sum([np.frombuffer(bytes(r[0]), np.int64) for r in gathered.where("kind = 'stats'").select("a").collect()] or [np.zeros(2, np.int64)], axis=0)
    total, vocabulary = int(stats[0]), int(stats[1])
    below = math.log10(total + 0.1 * (vocabulary + 1))
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches):
        bodies: dict[bytes, list] = {}
        answers: dict[bytes, dict] = {}
        for batch in batches:
            for _, kind, chunk, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "tokens":
                    bodies.setdefault(chunk, []).append(blobs)
                else:  # equal chunks have equal answers
                    answers.setdefault(chunk, {})[int.from_bytes(blobs[3], "little")] = blobs[:3]
        while bodies:
            chunk, copies = bodies.popitem()
            got = sorted(answers.pop(chunk).items())
            exact, w_level, p_level = (np.concatenate([_spread_out(x[i], t) for _, x in got]) for i, t in enumerate((np.int64, np.uint8, np.uint8)))
            both, u, times, rank = (_spread_out(x, t) for x, t in zip(copies[0], (np.int64, np.uint64, np.uint32, np.uint32)))
            ids, at, u = both[: len(both) // 2], both[len(both) // 2 :], np.cumsum(u, dtype=np.uint64)
            inverse = np.argsort(-times.astype(np.int64), kind="stable")[rank]
            tok, many = u[inverse], np.diff(at)
            count = _BETWEEN[w_level]
            one = ((count + 0.1) / 10**below)[inverse]
            two = _BETWEEN[p_level][_asked(tok, at, n)[1]]
            before = np.empty(len(tok))
            before[1:] = count[inverse][:-1]
            before[at[:-1]] = count[np.searchsorted(u, END)]
            given = np.minimum(1.0, two / np.maximum(before, 1.0))
            value = np.add.reduceat(np.log10((1 - W) * one + W * given), at[:-1])
            base = np.add.reduceat(np.log10(exact + 0.1)[inverse], at[:-1]) - many * below
            known = np.add.reduceat((exact > 0).astype(np.int64)[inverse], at[:-1])
            rows = pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == _NULL), pa.array(_held(ids)), pa.array(many), pa.array(known), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(value)], schema=schema
            )
            for _ in copies:
                yield rows

    return to_buckets(gathered.where("kind <> 'stats'"), n).mapInArrow(finish, shape)
