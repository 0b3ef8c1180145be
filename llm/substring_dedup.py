"""Substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words of one document.  Each window has a minimiser: of
its runs of ``m`` words the one with the least hash.  Consecutive windows that share a
minimiser travel together as one packed string of word hashes (a super-k-mer) to the
bucket of the minimiser, where sorting brings equal windows together and each but the
first, by (doc_id, start), is marked.

Three things keep the exchange small and even.  A first exchange counts the minimisers
alone: those that occur once in all documents are left out of the second one (a filter
of bounded size; its false positives only add rows).  Each task sends one of equal
super-k-mers, that with the smallest (doc_id, start), and marks the others itself, so
a passage that a third of all documents hold is sent once by each chunk of a task.  And
a minimiser that is more than HOT of a bucket's part is split: its windows travel one by
one, each to the bucket of its own hash.  A part of a bucket names at most 1 / HOT of them.

Buckets have PARTS parts each, sorted by Spark, which spills; a worker holds one part.

Defined results.  Windows are equal if their words' 64-bit hashes are equal in order;
sorted runs of one window hash are compared word by word.  A null or blank text has no
word.  A null doc_id stands before every other; rows that repeat both doc_id and text
are one place each, so neither starts earlier than the other.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bits_key, bits_of, bucket_of, buckets, chunks, cut, ints, packed, ranges, release, run_starts, split_by, to_buckets, trim, Bits, segment
from llm.textkernel import mix, scan_words, shingles, text_bytes

M = 8
FILTER_BITS = 1 << 27
CHUNK = 4 << 20
PARTS = 16
HOT = 0.25
LEAST_HOT = 256
_C = np.uint64(0xA0761D6478BD642F)
_ENTRY = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<u4"), ("words", "<u4")])


def row_keys(ids: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's doc_id and words."""
    acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.arange(len(h), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64) * np.uint64(1)))))
    return mix(acc[at[1:]] - acc[at[:-1]] ^ mix(ids.view(np.uint64) + _C)).view(np.int64)


def super_kmers(h: np.ndarray, at: np.ndarray, k: int, m: int):
    """(row, first word, windows, minimiser) of each super-k-mer of rows h[at[i]:at[i+1]].

    Minimisers are hashed once more: least hashes alone would crowd the first buckets.
    """
    n = len(h)
    if n < k:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    gram = mix(shingles(h, m) ^ _C)
    span = k - m + 1
    # least hash of span neighbours, with the place of its last occurrence, by doubling
    best, where, width = gram, np.arange(len(gram)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[:-step], best[step:]
        take = b <= a
        best, where = np.where(take, b, a), np.where(take, where[step:], where[:-step])
        width += step
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(best)]
    inside = np.arange(len(best)) + k <= at[row + 1]
    place, best, row = np.flatnonzero(inside), best[inside], row[inside]
    where = where[inside]
    if len(place) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    new = np.concatenate(([True], (where[1:] != where[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    return row[first], place[first], np.diff(np.append(first, len(place))), mix(best[first] + _C)


def _scan(batch: pa.RecordBatch):
    data, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
    _, _, h, at = scan_words(data, offs)
    ids = ints(batch.column(batch.schema.get_field_index("doc_id")))
    return ids, h, at, row_keys(ids, h, at)


def _distinct(batch: pa.RecordBatch, k: int, m: int):
    """The super-k-mers of a chunk in the order of (minimiser, words, doc_id, start), and which are the first of their kind."""
    ids, h, at, keys = _scan(batch)
    row, place, windows, low = super_kmers(h, at, k, m)
    words = windows + k - 1
    acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + _C))))
    # a fingerprint of the content groups equal ones; order within the words counts through the shingles of k words
    win = shingles(h, k) if len(h) >= k else np.zeros(0, np.uint64)
    wacc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(win)))
    content = mix((wacc[place + windows] - wacc[place]) ^ mix(acc[place + words] - acc[place] + windows.astype(np.uint64)))
    start = place - at[row]
    order = np.lexsort((start, ids[row], content, low))
    row, place, windows, low, content, start, words = (x[order] for x in (row, place, windows, low, content, start, words))
    same = np.concatenate(([False], (low[1:] == low[:-1]) & (content[1:] == content[:-1]) & (windows[1:] == windows[:-1])))
    for i in np.flatnonzero(same):  # equal fingerprints are compared word by word
        a, b, w = place[i], place[i - 1], words[i]
        if not np.array_equal(h[a : a + w], h[b : b + w]):
            same[i] = False
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    # repeated rows: what stands at the same (doc_id, start) as the first does not start later
    later = same & ((ids[row] != ids[row[lead]]) | (start != start[lead])) if len(same) else same
    return ids, h, keys, row, place, windows, low, start, words, same, later


def _minimisers(docs: DataFrame, k: int, m: int, n: int) -> tuple[Bits, np.ndarray]:
    """A filter that holds every minimiser of two super-k-mers or more, and the hot minimisers' remainders by part.

    The hot ones are (part << 32 | low 32 bits), sorted.
    """
    shape = "bucket int, blob binary, hot array<long>"
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("hot", pa.list_(pa.int64()))])
    size = max(1, FILTER_BITS // 8 // n)

    def spread(batches):
        for batch in chunks(batches, "text", CHUNK):
            _, h, at, _ = _scan(batch)
            x, many = np.unique(super_kmers(h, at, k, m)[3], return_counts=True)
            cut_at = np.searchsorted(bucket_of(x, n), np.arange(n + 1))
            many = np.minimum(many, 0xFFFF).astype(np.uint16)
            rows = [(b, x[cut_at[b] : cut_at[b + 1]].tobytes() + many[cut_at[b] : cut_at[b + 1]].tobytes(), None) for b in range(n) if cut_at[b + 1] > cut_at[b]]
            if rows:
                yield packed(schema, rows)

    def repeated(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append((np.frombuffer(blob, np.uint64, len(blob) // 10), np.frombuffer(blob, np.uint16, len(blob) // 10, len(blob) // 10 * 8)))
        while held:
            b, parts = held.popitem()
            x = np.concatenate([p[0] for p in parts])
            order = np.argsort(x)
            at = run_starts(x := x[order])
            many = np.add.reduceat(np.concatenate([p[1] for p in parts])[order].astype(np.int64), at)
            x = x[at]
            part = bucket_of(x, n * PARTS)
            whole = np.bincount(part - b * PARTS, weights=many, minlength=PARTS)
            hot = (many > LEAST_HOT) & (many > HOT * whole[part - b * PARTS])
            x_hot = (part[hot].astype(np.int64) << 32) | (x[hot] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            x = x[many > 1]
            yield packed(schema, [(b, segment(x, size) if len(x) else b"", x_hot.tolist())])

    rows = to_buckets(docs.mapInArrow(spread, shape), n).mapInArrow(repeated, shape).collect()
    return Bits({r[0]: bytes(r[1]) for r in rows if len(r[1])}, n), np.sort(np.array([x for r in rows for x in r[2]], np.int64))


def repeated_spans(docs: DataFrame, k: int = 20, m: int = M) -> DataFrame:
    """(key, start, words): the spans of words, by row key, that windows starting earlier elsewhere repeat."""
    spark = docs.sparkSession
    n = buckets(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = spark.sparkContext.broadcast(_minimisers(docs, k, m, n))
    shape = "bucket int, part int, key long, start long, words long, blob binary"
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("key", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("blob", pa.binary())])

    def spread(batches):
        filter_, hot_ones = wanted.value
        for batch in chunks(batches, "text", CHUNK):
            ids, h, keys, row, place, windows, low, start, words, same, later = _distinct(batch, k, m)
            if not len(row):
                continue
            rows = []
            yield from _spans(keys, row[later], start[later], words[later], n, schema)
            # at equal places all of them are kept apart for the bucket to see
            send = np.flatnonzero(~later & filter_.has(low))
            part = bucket_of(low[send], n * PARTS)
            hot = np.isin((part.astype(np.int64) << 32) | (low[send] & np.uint64(0xFFFFFFFF)).astype(np.int64), hot_ones)
            # a hot super-k-mer goes as its windows, each a super-k-mer of its own
            single = np.repeat(send[hot], windows[send[hot]])
            shift = ranges(np.zeros(int(hot.sum()), np.int64), windows[send[hot]])
            win = shingles(h, k)[place[single] + shift] if len(single) else np.zeros(0, np.uint64)
            part = np.concatenate((part[~hot], bucket_of(win, n * PARTS)))
            send, shift = np.concatenate((send[~hot], single)), np.concatenate((np.zeros(int((~hot).sum()), np.int64), shift))
            many = np.concatenate((words[send[: len(send) - len(single)]], np.full(len(single), k, np.int64)))
            order, cut_at = split_by(part, n * PARTS)
            send, shift, many = send[order], shift[order], many[order]
            e = np.empty(len(send), _ENTRY)
            e["doc"], e["key"], e["start"], e["words"] = ids[row[send]], keys[row[send]], start[send] + shift, many
            ends = np.concatenate(([0], np.cumsum(many)))
            body = h[ranges(place[send] + shift, many)]
            for b in np.flatnonzero(np.diff(cut_at)).tolist():
                a, z = cut_at[b], cut_at[b + 1]
                rows.append((b // PARTS, b, None, None, None, np.uint32(z - a).tobytes() + e[a:z].tobytes() + body[ends[a] : ends[z]].tobytes()))
            if rows:
                yield packed(schema, rows)

    def sort_windows(batches):
        now, held = None, []
        for batch in batches:
            blobs = batch.column(5)
            done = batch.filter(pa.compute.is_null(blobs))
            if done.num_rows:
                yield done
            rest = batch.filter(pa.compute.is_valid(blobs))
            for part, blob in zip(rest.column(1).to_pylist(), rest.column(5).to_pylist()):
                if part != now and held:
                    yield from sort_part(held)
                    held = []
                    trim()
                now = part
                held.append(blob)
        if held:
            yield from sort_part(held)

    def sort_part(blobs):
        entries, bodies = [], []
        for blob in blobs:
            c = int(np.frombuffer(blob, np.uint32, 1)[0])
            entries.append(np.frombuffer(blob, _ENTRY, c, 4))
            bodies.append(np.frombuffer(blob, np.uint64, -1, 4 + c * _ENTRY.itemsize))
        e, h = np.concatenate(entries), np.concatenate(bodies)
        words = e["words"].astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(words)))[:-1]
        many = words - k + 1
        owner = np.repeat(np.arange(len(e)), many)
        place = ranges(begin, many)
        start = e["start"][owner].astype(np.int64) + place - begin[owner]
        win = shingles(h, k)[place]
        doc = e["doc"][owner]
        order = np.lexsort((start, doc, win))
        win, doc, start, place, owner = win[order], doc[order], start[order], place[order], owner[order]
        new = np.concatenate(([True], win[1:] != win[:-1]))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(win)), 0))
        true = np.ones(len(win), bool)
        for j in range(k):
            true &= h[place + j] == h[place[lead] + j]
        late = true & ((doc != doc[lead]) | (start != start[lead]))
        for i in np.unique(lead[~true]).tolist():  # one hash, other words: group by the words themselves
            z = i + 1
            while z < len(win) and not new[z]:
                z += 1
            first: dict[bytes, int] = {}
            for j in range(i, z):
                w = h[place[j] : place[j] + k].tobytes()
                f = first.setdefault(w, j)
                late[j] = (doc[j], start[j]) != (doc[f], start[f])
        # neighbouring marked windows of a super-k-mer become one span
        owner, start = owner[late], start[late]
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        if not len(owner):
            return
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
        last = np.append(first[1:], len(owner)) - 1
        key = e["key"][owner[first]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(first), np.int32)), pa.nulls(len(first), pa.int32()), pa.array(key), pa.array(start[first]), pa.array(start[last] - start[first] + k), pa.nulls(len(first), pa.binary())], schema=schema
        )

    return to_buckets(docs.mapInArrow(spread, shape), n).sortWithinPartitions("part").mapInArrow(sort_windows, shape).select("key", "start", "words")


def _spans(keys, row, start, words, n: int, schema: pa.Schema):
    """Overlapping or touching spans of a row become one."""
    if not len(row):
        return
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + words)[order]
    base = row.astype(np.int64) << 40  # rows apart, so one running maximum serves all of them
    reach = np.maximum.accumulate(base + end)
    first = np.flatnonzero(np.concatenate(([True], (base + start)[1:] > reach[:-1])))
    last = np.append(first[1:], len(row)) - 1
    key = keys[row[first]]
    yield pa.RecordBatch.from_arrays(
        [pa.array((key % n).astype(np.int32)), pa.nulls(len(first), pa.int32()), pa.array(key), pa.array(start[first].astype(np.int64)), pa.array((reach[last] - base[first] - start[first]).astype(np.int64)), pa.nulls(len(first), pa.binary())], schema=schema
    )


def _kept(words: list[bytes], spans) -> tuple[list[bytes], int]:
    keep = np.ones(len(words), bool)
    for s, w in spans:
        keep[s : s + w] = False
    return [x for x, y in zip(words, keep.tolist()) if y], int((~keep).sum())


def remove_repeats(docs: DataFrame, k: int = 20, m: int = M) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's words without the repeated ones, joined by one space."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = cut(repeated_spans(docs, k, m), "substring-spans")
    release(spark)
    touched = spark.sparkContext.broadcast(bits_of(spans, "key", FILTER_BITS))
    kept = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def each(batches, hit: bool):
        for batch in chunks(batches, "text", CHUNK):
            _, _, _, keys = _scan(batch)
            mask = touched.value.has(bits_key(keys))
            mask = mask if hit else ~mask
            part = batch.filter(pa.array(mask))
            if not part.num_rows:
                continue
            if hit:
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(keys[mask]), part.column("text").cast(pa.string())], names=["doc_id", "key", "text"])
            else:
                words = [(t or "").encode().split() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(np.zeros(len(words), np.int64)), pa.array([b" ".join(w).decode() for w in words], pa.string())], schema=kept
                )

    def untouched(batches):
        return each(batches, False)

    def hits(batches):
        return each(batches, True)

    def take_out(batches):
        for batch in batches:
            rows = []
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                words = (text or "").encode().split()
                left, gone = _kept(words, [(s["start"], s["words"]) for s in spans or ()])
                rows.append((i, len(words), gone, b" ".join(left).decode()))
            yield packed(kept, rows)

    shape = "doc_id long, n_words long, n_removed long, kept string"
    by_key = spans.groupBy("key").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    changed = docs.mapInArrow(hits, "doc_id long, key long, text string").join(by_key, "key", "left").select("doc_id", "text", "spans").mapInArrow(take_out, shape)
    return docs.mapInArrow(untouched, shape).unionByName(changed)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
