"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item leaks into a document if the document holds at least ``num/den`` of the
item's distinct ``k``-word shingles (A-Z lower-cased).  Items are partitioned by size:
those of up to ``u`` shingles, ``u`` a power of two, carry a sketch of
``floor(u (1 - num/den)) + 1`` of their MinHash values: the least ones of those that the fewest
items of the block share, so that what a template puts into all items is asked for last.  A leaked item misses at most that
many less one, so a document without any sketch value of an item can't contain it; all
other pairs are verified by exact containment.  A signature of the document's side
would not do: one of 20,000 words and an item of 50 have a Jaccard similarity near
0.002, which no fixed number of bands finds.

Each size class has a table of its own; a document's shingles are looked up in a small
bit table first, and those that pass in the table of each class.  Of the sketch values, a
leaked item's class says how many a document must hold at least.

Items are broadcast in blocks of about BLOCK_BYTES of text; a test set of more than one
block takes a pass over the documents for each, whose result is written before the next
block is broadcast, so that one index is live at a time.  Documents are not shuffled.

Defined results.  An item of fewer than k words is one shingle of its own length; one
without a word is never found.  A null or blank text holds nothing.  Null ids pass
through as null.  Repeated rows on either side give a result each.  Columns other than
doc_id, text, item_id are ignored by ``leaks`` and returned as they are by ``clean``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import chunks, cut, packed, ranges
from llm.textkernel import mix, scan_words, shingles, text_bytes, whole

BLOCK_BYTES = 16 << 20
SLICE = 1 << 20
_D = np.uint64(0x2545F4914F6CDD1D)
_MASK = (1 << 22) - 1


def _words(texts: list[str | None]):
    data, offs = text_bytes(pa.array(texts, pa.string()))
    _, _, h, at = scan_words(data, offs, lower=True)
    return [h[a:b] for a, b in zip(at[:-1], at[1:])]


class ItemIndex:
    """Sketches of one block of items, by shingle length."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int, num: int, den: int):
        self.num, self.den = num, den
        self.ids, self.sets, bound = [], [], []
        rows: dict[int, dict[int, list[tuple[int, int]]]] = {}
        found = [(item, min(k, len(h)), np.unique(shingles(h, min(k, len(h))))) for item, h in zip((i for i, _ in items), _words([t for _, t in items])) if len(h)]
        common, often = np.unique(np.concatenate([s for *_, s in found] or [np.zeros(0, np.uint64)]), return_counts=True)
        for item, width, s in found:
            upper = 1 << (len(s) - 1).bit_length()
            least = mix(s ^ _D)
            sketch = least[np.lexsort((least, often[np.searchsorted(common, s)]))][: upper * (den - num) // den + 1]
            # of the sketch, a leaked item holds at least this many values
            bound.append(max(1, len(sketch) - len(s) * (den - num) // den))
            rows.setdefault(width, {}).setdefault(upper, []).extend((int(v), len(self.ids)) for v in sketch)
            self.ids.append(item)
            self.sets.append(s)
        self.bound = np.array(bound, np.int64)
        #: by shingle length: a bit table, and for each size class its sorted sketch values with their items
        self.sketches: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for width, classes in rows.items():
            seen, tables = np.zeros(_MASK + 1, bool), []
            for upper in sorted(classes):
                pairs = sorted(classes[upper])
                values, owners = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
                seen[(values & np.uint64(_MASK)).astype(np.int64)] = True
                tables.append((values, owners))
            self.sketches[width] = (seen, tables)

    def find(self, batch: pa.RecordBatch):
        """(row, item, shared, size) of each leak in a batch."""
        data, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
        _, _, h, at = scan_words(data, offs, lower=True)
        for width, (seen, tables) in self.sketches.items():
            x = shingles(h, width)
            y = mix(x ^ _D)
            hit = np.flatnonzero(seen[(y & np.uint64(_MASK)).astype(np.int64)])
            row = np.searchsorted(at, hit, side="right") - 1
            inside = hit + width <= at[row + 1]
            row, y = row[inside], y[hit[inside]]
            held: tuple[int, np.ndarray] = (-1, x[:0])
            for r, o in self._candidates(row, y, tables):
                if held[0] != r:
                    held = (r, np.unique(x[at[r] : max(at[r], at[r + 1] - width + 1)]))
                s = self.sets[o]
                place = np.minimum(np.searchsorted(held[1], s), len(held[1]) - 1)
                shared = int((held[1][place] == s).sum())
                if self.den * shared >= self.num * len(s):
                    yield r, self.ids[o], shared, len(s)

    def _candidates(self, row: np.ndarray, y: np.ndarray, tables: list) -> list[tuple[int, int]]:
        """(row, item) pairs, sorted, that share enough sketch values; row and y are a batch's probes.

        A value counts once a row.  Its owners are walked in slices of about SLICE pairs, so that values which
        many items own take no more memory than others.
        """
        out, n = [], max(1, len(self.ids))
        for values, owners in tables:
            left = np.searchsorted(values, y, side="left")
            known = np.flatnonzero((left < len(values)) & (values[np.minimum(left, len(values) - 1)] == y))
            # each value of a row once, by its first place in the table
            probes = np.unique(row[known] * np.int64(len(values)) + left[known])
            r, at = probes // len(values), probes % len(values)
            many = np.searchsorted(values, values[at], side="right") - at
            total = np.concatenate(([0], np.cumsum(many)))
            rest: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            a = 0
            while a < len(r):
                b = max(a + 1, int(np.searchsorted(total, total[a] + SLICE, side="right")) - 1)
                pairs, seen = np.unique(np.repeat(r[a:b], many[a:b]) * n + owners[ranges(at[a:b], many[a:b])], return_counts=True)
                pairs, back = np.unique(np.concatenate((rest[0], pairs)), return_inverse=True)
                held = np.bincount(back, np.concatenate((rest[1], seen)), len(pairs)).astype(np.int64)
                # the last row may go on in the next slice
                open_row = pairs // n == (r[b] if b < len(r) else -1)
                rest = (pairs[open_row], held[open_row])
                done = pairs[~open_row & (held >= self.bound[pairs % n])]
                out += zip((done // n).tolist(), (done % n).tolist())
                a = b
        return sorted(out)


def _blocks(items: DataFrame):
    """The items in blocks whose text is bounded, as lists."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-int(total[0]) // BLOCK_BYTES), -(-int(total[1]) // 100_000))
    for b in range(n):
        block = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]
        if block:
            yield block


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, item_id, shared, size): each document that holds num/den or more of an item's shingles."""
    spark = docs.sparkSession
    shape = "doc_id long, item_id long, shared long, size long"
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "shared", "size")])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(index):
        def find(batches):
            for batch in chunks(batches, "text"):
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], *rest) for r, *rest in index.value.find(batch)]
                if rows:
                    yield packed(schema, rows)

        return docs.mapInArrow(find, shape)

    parts = _passes(spark, items, lambda i: ItemIndex(i, k, num, den), search)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], shape)


def clean(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""

    def search(index):
        nonlocal docs

        def keep(batches):
            for batch in chunks(batches, "text"):
                good = np.ones(batch.num_rows, bool)
                good[[r for r, *_ in index.value.find(batch)]] = False
                if good.any():
                    yield batch.filter(pa.array(good))

        return docs.mapInArrow(keep, docs.schema)

    def hold(part):
        nonlocal docs
        docs = part

    _passes(docs.sparkSession, items, lambda i: ItemIndex(i, k, num, den), search, hold)
    return docs


def _passes(spark, items: DataFrame, build, search, hold=lambda part: None) -> list[DataFrame]:
    """search over the broadcast index of each block; all passes but the last are written before the next begins."""
    out, live = [], None
    for block in _blocks(items):
        if live is not None:
            out[-1] = cut(out[-1], "item-pass")
            hold(out[-1])
            live.unpersist()
        live = spark.sparkContext.broadcast(build(block))
        out.append(search(live))
        hold(out[-1])
    return out
