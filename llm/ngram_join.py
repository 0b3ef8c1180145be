"""N-gram Jaccard join by multiple-global-order filtering.

Documents are sets of distinct k-word shingles (ASCII letters lower-cased; fewer
than k words count as one shingle).  Two documents link when
``den * |x & y| >= num * |x | y|``.  The steps:

1. Equal sets are one node, named by a 64-bit fingerprint of the set.
2. Each chunk of a task counts its shingles, and buckets add the counts up.  A bucket
   returns a filter that holds ``floor(log2(count))`` levels of each of its shingles, of a
   bounded number of bits: where they would not do, it starts at a higher level.
3. ``ORDERS`` global orders rank shingles by their level, rare ones first, and within a
   level by a hash of the order's own.  A linked pair shares one of the first
   ``n - ceil(n num/den) + 1`` shingles under every one of them.
4. Under each order, sets that share a prefix shingle are tied: of those of one size
   class (linked sets are of the same or neighbouring classes) each to the least, and the
   least to the next class's.  The ties are a forest, so no list gives pairs, whatever its
   length, and a chunk sends one entry for each shingle and class.  Components of the ties
   are an order's candidates, and the filters are intersected: sets are compared only if
   they are in one component under every order.
5. Each group's sets meet in cells of about ``cell`` sets and ``cell_shingles`` shingles,
   and every overlap in a cell is counted exactly from an inverted index over the
   differences from the cell's majority set.
6. Linked sets give components; each document takes the smallest doc_id of its own.

Defined results.  A null or blank text has no shingle, links with nothing and is its
own component.  A null doc_id takes part, is never the smallest id and, alone, has a
null component.  Repeated rows link with each other and stay separate rows.  Other
columns of the input are ignored.  Texts are used whole, whatever their length.
Fingerprints are 64 bits wide: of N distinct sets about N*N/2**65 pairs merge wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bits_key, bits_of, bucket_of, buckets, chunks, components, cut, discard, ints, packed, ranges, release, run_starts, salted_join, split_by, to_buckets
from llm.textkernel import mix, scan_words, shingle_set, text_bytes

ORDERS = 3
ORDER_BITS = 1 << 27
MEMBER_BITS = 1 << 26
CELL = 4096
CELL_SHINGLES = 1 << 20
_B = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
_ORDER_SALTS = [(np.uint64(2 * i + 1), np.uint64(0xD6E8FEB86659FD93 * (i + 1) & (2**64 - 1))) for i in range(ORDERS)]


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def size_classes(num: int, den: int, top: int = 1 << 31) -> np.ndarray:
    """Bounds of classes of set sizes; sizes of a linked pair are in one class or in neighbouring ones."""
    if not 0 < num < den:
        raise ValueError("the share is above 0 and below 1")
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def fingerprint(x: np.ndarray) -> int:
    """Of a sorted set of hashes; as a signed long."""
    acc = mix(x ^ _B).sum(dtype=np.uint64) ^ mix(np.array([len(x)], np.uint64))[0]
    return int(mix(np.array([acc], np.uint64)).view(np.int64)[0])


def document_sets(batch: pa.RecordBatch, k: int):
    """(row, set) of a batch whose column text is read."""
    data, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
    _, _, h, at = scan_words(data, offs, lower=True)
    for i in range(batch.num_rows):
        yield i, shingle_set(h[at[i] : at[i + 1]], k)


def distinct_sets(batch: pa.RecordBatch, k: int) -> dict[int, np.ndarray]:
    """The sets of a chunk by fingerprint, without the empty one."""
    out: dict[int, np.ndarray] = {}
    for _, x in document_sets(batch, k):
        if len(x):
            out.setdefault(fingerprint(x), x)
    return out


def overlap_links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The smallest index linked to each set through any links: exact, without listing pairs.

    Each set is coded by its difference from the tokens that more than half of the sets
    hold, which leaves every symmetric difference as it is.  For one set at a time,
    overlaps with all others come from the posting lists of its own tokens.
    """
    m = len(sets)
    label = np.arange(m)
    if m < 2:
        return label
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(2 * count > m)
    if len(common):
        rest = ~np.isin(inverse, common)
        have = np.zeros((m, len(common)), bool)
        have[owner[~rest], np.searchsorted(common, inverse[~rest])] = True
        lack_owner, lack_token = np.nonzero(~have)
        owner = np.concatenate((owner[rest], lack_owner))
        inverse = np.concatenate((inverse[rest], common[lack_token]))
    delta = np.bincount(owner, minlength=m)
    by_token = np.argsort(inverse, kind="stable")
    members, list_at = owner[by_token], np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(tokens)))))
    by_owner = np.argsort(owner, kind="stable")
    mine, mine_at = inverse[by_owner], np.concatenate(([0], np.cumsum(delta)))
    for i in np.argsort(delta, kind="stable"):
        t = mine[mine_at[i] : mine_at[i + 1]]
        shared = np.bincount(members[ranges(list_at[t], list_at[t + 1] - list_at[t])], minlength=m)
        apart = delta[i] + delta - 2 * shared
        both = size[i] + size
        near = (label != label[i]) & (den * (both - apart) >= num * (both + apart))
        if near.any():
            hit = np.unique(label[near])
            low = min(int(label[i]), int(hit[0]))
            label[np.isin(label, hit) | (label == label[i])] = low
    return label


def _count_stage(docs: DataFrame, k: int, n: int, order_bits: int) -> DataFrame:
    """Rows of kind doc (doc_id, fp, n) and order (a bucket's filter, whose lowest level is n)."""
    shape = "bucket int, kind string, doc_id long, fp long, n long, blob binary"
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

    def spread(batches):
        for batch in chunks(batches, "text"):
            column = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            ids, home = column.to_pylist(), (mix(ints(column).view(np.uint64)) % np.uint64(n)).tolist()
            sets, rows = {}, []
            for i, x in document_sets(batch, k):
                fp = fingerprint(x)
                rows.append((home[i], "doc", ids[i], fp, len(x), None))
                sets.setdefault(fp, x)
            x, c = np.unique(np.concatenate(list(sets.values())), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            at = np.searchsorted(bucket_of(x, n), np.arange(n + 1))  # x is sorted, and so are its buckets
            low, c = x.astype(np.uint32), np.minimum(c, 0xFFFF).astype(np.uint16)
            rows += [(b, "count", None, None, int(at[b + 1] - at[b]), low[at[b] : at[b + 1]].tobytes() + c[at[b] : at[b + 1]].tobytes()) for b in range(n) if at[b + 1] > at[b]]
            yield packed(schema, rows)

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            kinds = batch.column(1)
            docs_ = batch.filter(pa.compute.equal(kinds, "doc"))
            if docs_.num_rows:
                yield docs_
            rest = batch.filter(pa.compute.equal(kinds, "count"))
            for b, m, blob in zip(rest.column(0).to_pylist(), rest.column(4).to_pylist(), rest.column(5).to_pylist()):
                held.setdefault(b, []).append((np.frombuffer(blob, np.uint32, m), np.frombuffer(blob, np.uint16, m, 4 * m)))
        while held:
            b, parts = held.popitem()
            x = np.concatenate([p[0] for p in parts])
            order = np.argsort(x, kind="stable")
            at = run_starts(x := x[order])
            c = np.add.reduceat(np.concatenate([p[1] for p in parts])[order].astype(np.int64), at)
            yield packed(schema, [(b, "order", None, None, *_frequency_segment(x[at].astype(np.uint64), c, max(64, order_bits // n)))])

    return to_buckets(docs.select("doc_id", "text").mapInArrow(spread, shape), n).mapInArrow(count, shape)


def _place(key: np.ndarray, level: int, bits) -> np.ndarray:
    return (mix(key + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(8)) % bits


def _frequency_segment(low: np.ndarray, count: np.ndarray, most: int) -> tuple[int, bytes]:
    """(lowest level, filter) of a bucket's shingles: 8 to 16 bits an entry, and most bits at most.

    Where these are few, the filter may be filled to three quarters before a level is given up:
    a set stays at home if as many of its shingles as its prefix is long occur once for certain,
    which is so for most sets when a quarter of their lone shingles is told, and for none without level 1.
    """
    level = np.frexp(count)[1] - 1  # floor(log2)
    entries = [int((level >= j).sum()) for j in range(int(level.max(initial=0)) + 2)]
    base = next(j for j in range(1, len(entries) + 1) if 3 * sum(entries[j:]) <= 4 * most)
    bits, need = 64, 8 * sum(entries[base:])
    while bits < need and 2 * bits <= most:
        bits *= 2
    if bits < need:
        bits = most // 64 * 64
    out = np.zeros(bits, bool)
    for j in range(base, len(entries)):
        out[_place(low[level >= j], j, np.uint64(bits)).astype(np.int64)] = True
    return base, np.packbits(out, bitorder="little").tobytes()


class ShingleOrders:
    """The global orders of step 3, from filters of at most order_bits bits, whatever the rows."""

    def __init__(self, rows: list, n: int):
        self.n = n
        segments = {r["bucket"]: (r["n"], bytes(r["blob"])) for r in rows}
        parts = [segments.get(b, (1, bytes(8))) for b in range(n)]
        self.base = np.array([p[0] for p in parts], np.int64)
        self.size = np.array([len(p[1]) * 8 for p in parts], np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1].astype(np.uint64)
        self.bits = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)

    def levels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level, whether it is certain to occur once) of each shingle; a level never is too low."""
        b = bucket_of(x, self.n)
        low, size, start, base = x & _LOW, self.size[b], self.start[b], self.base[b]
        level = np.zeros(len(x), np.uint8)
        alive, step = np.arange(len(x)), 0
        while len(alive):
            key = low[alive] + (base[alive] + step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at = start[alive] + (mix(key) >> np.uint64(8)) % size[alive]
            alive = alive[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            level[alive] += 1
            step += 1
            if step > 40:
                break
        return np.where(level > 0, level + (base - 1).astype(np.uint8), level).astype(np.uint8), (level == 0) & (base == 1)

    def prefixes(self, x: np.ndarray, level: np.ndarray, lone: np.ndarray, length: int) -> list[np.ndarray]:
        """The prefix of a set under each order, without the shingles that occur once."""
        if int(lone.sum()) >= length:  # they come first under every order
            return []
        # ranks follow from bucket and remainder only, as do the counts: equal keys are one token everywhere
        key = (bucket_of(x, self.n).astype(np.uint64) << np.uint64(32)) | (x & _LOW)
        top = level.astype(np.uint64) << np.uint64(56)
        out = []
        for factor, salt in _ORDER_SALTS:
            rank = (mix(key * factor + salt) >> np.uint64(8)) | top
            first = np.argpartition(rank, length - 1)[:length]
            out.append(x[first[~lone[first]]])
        return out


_ENTRY = np.dtype([("token", "<u4"), ("size", "<u2"), ("fp", "<i8")])
_TIE_SHAPE = "bucket int, kind int, u long, v long, blob binary"
_TIE_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("blob", pa.binary())])


def _ties(u: np.ndarray, v: np.ndarray, kind: int, n: int):
    """Rows of distinct ties, dealt out by their own hash."""
    u, v = np.maximum(u, v), np.minimum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) & (u != v) if len(u) else np.zeros(0, bool)
    u, v = u[new], v[new]
    if len(u):
        b = (mix(u.view(np.uint64) ^ mix(v.view(np.uint64))) % np.uint64(n)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v), pa.nulls(len(u), pa.binary())], schema=_TIE_SCHEMA)


def _tie_stage(docs: DataFrame, orders: ShingleOrders, k: int, num: int, den: int) -> DataFrame:
    """(kind, u, v): under each order, a forest of ties between sets that share a prefix shingle."""
    n = orders.n
    shared = docs.sparkSession.sparkContext.broadcast(orders)
    bounds = size_classes(num, den)

    def spread(batches):
        orders = shared.value
        for batch in chunks(batches, "text"):
            sets = distinct_sets(batch, k)
            if not sets:
                continue
            level, lone = orders.levels(np.concatenate(list(sets.values())))
            found: list[list] = [[] for _ in range(ORDERS)]
            at = 0
            for fp, x in sets.items():
                here = slice(at, at + len(x))
                at += len(x)
                for kind, tokens in enumerate(orders.prefixes(x, level[here], lone[here], prefix_length(len(x), num, den))):
                    if len(tokens):
                        found[kind].append((tokens, fp, len(x)))
            for kind, lists in enumerate(found):
                if not lists:
                    continue
                many = np.array([len(f[0]) for f in lists])
                x = np.concatenate([f[0] for f in lists])
                e = np.empty(len(x), _ENTRY)
                e["token"] = x.astype(np.uint32)
                e["fp"] = np.repeat(np.array([f[1] for f in lists], np.int64), many)
                e["size"] = np.repeat(np.searchsorted(bounds, np.array([f[2] for f in lists]), side="right"), many)
                b = bucket_of(x, n)
                order = np.lexsort((e["fp"], e["size"], e["token"], b))
                e, b = e[order], b[order]
                new = np.concatenate(([True], (b[1:] != b[:-1]) | (e["token"][1:] != e["token"][:-1]) | (e["size"][1:] != e["size"][:-1])))
                first = np.flatnonzero(new)
                lead = np.repeat(first, np.diff(np.append(first, len(e))))
                yield from _ties(e["fp"][~new], e["fp"][lead[~new]], kind, n)
                e, b = e[first], b[first]
                cut_at = np.searchsorted(b, np.arange(n + 1))
                yield packed(_TIE_SCHEMA, [(i, kind, None, None, e[cut_at[i] : cut_at[i + 1]].tobytes()) for i in range(n) if cut_at[i + 1] > cut_at[i]])

    def tie(batches):
        held: dict[int, list] = {}
        for batch in batches:
            blobs = batch.column(4)
            done = batch.filter(pa.compute.is_null(blobs))
            if done.num_rows:
                yield done
            rest = batch.filter(pa.compute.is_valid(blobs))
            for kind, blob in zip(rest.column(1).to_pylist(), rest.column(4).to_pylist()):
                held.setdefault(kind, []).append(np.frombuffer(blob, _ENTRY))
        while held:
            kind, parts = held.popitem()
            e = np.concatenate(parts)
            e = e[np.lexsort((e["fp"], e["size"], e["token"]))]
            near = (e["token"][1:] == e["token"][:-1]) & (e["size"][1:] - e["size"][:-1] <= 1)
            yield from _ties(e["fp"][1:][near], e["fp"][:-1][near], kind, n)

    return to_buckets(docs.select("text").mapInArrow(spread, _TIE_SHAPE), n).mapInArrow(tie, _TIE_SHAPE).select("kind", "u", "v")


def _groups(ties: DataFrame, sizes: DataFrame, cell: int, cell_shingles: int) -> DataFrame:
    """(node, root, parts): the sets that are in one component under every order, by group, and its number of parts."""
    by_order = components(ties, "ngram-orders", ("kind",))
    roots = [F.max(F.when(F.col("kind") == i, F.col("root"))) for i in range(ORDERS)]
    met = by_order.groupBy("node").agg(F.xxhash64(*roots).alias("root"), F.count("*").alias("orders")).where(F.col("orders") == ORDERS).drop("orders")
    met = met.join(sizes, "node")
    of = met.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    of = of.select("root", F.ceil(F.greatest(F.col("sets") / cell, F.col("shingles") / cell_shingles)).cast("int").alias("parts"))
    return salted_join(met, of, "root", "inner").select("node", "root", "parts")


def _cell_stage(docs: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(u, v) edges of a forest of links, from the exact overlaps within each cell."""
    spark = docs.sparkSession
    n = buckets(spark)
    members = spark.sparkContext.broadcast(bits_of(groups, "node", min(MEMBER_BITS, 1024 * n + 16 * groups.count())))

    def sets(batches):
        schema = pa.schema([("node", pa.int64()), ("blob", pa.binary())])
        for batch in chunks(batches, "text"):
            found = distinct_sets(batch, k)
            fps = np.array(list(found), np.int64)
            rows = [(int(f), found[int(f)].tobytes()) for f in fps[members.value.has(bits_key(fps))]] if len(fps) else []
            if rows:
                yield packed(schema, rows)

    placed = groups.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a group of one part is one cell; of more, each two parts meet in a cell
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "node", F.struct("root", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).alias("cell")
    )
    have = docs.select("text").mapInArrow(sets, "node long, blob binary").groupBy("node").agg(F.first("blob").alias("blob"))
    rows = cells.join(have, "node").select(F.col("cell.root").alias("root"), F.col("cell.a").alias("a"), F.col("cell.b").alias("b"), "node", "blob")

    def link(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def done(nodes, blobs):
            x = [np.frombuffer(s, np.uint64) for s in blobs]
            label = overlap_links(x, num, den)
            f = np.array(nodes, np.int64)
            tied = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(f[tied]), pa.array(f[label[tied]])], schema=schema)

        now, nodes, blobs = None, [], []
        for batch in batches:
            for r, a, b, node, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (r, a, b) != now and nodes:
                    yield done(nodes, blobs)
                    nodes, blobs = [], []
                now = (r, a, b)
                nodes.append(node)
                blobs.append(blob)
        if nodes:
            yield done(nodes, blobs)

    return rows.repartition(n, "root", "a", "b").sortWithinPartitions("root", "a", "b", "node").mapInArrow(link, "u long, v long")


def _joined(docs: DataFrame, k: int, num: int, den: int, cell: int, cell_shingles: int, order_bits: int) -> DataFrame:
    """(doc_id, fp, n, root) for each row of docs (doc_id, text): its set, the set's size and the least set that links reach."""
    spark = docs.sparkSession
    n = buckets(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = cut(_count_stage(docs, k, n, order_bits), "ngram-counts")
    orders = ShingleOrders(counted.where("kind = 'order'").select("bucket", "n", "blob").collect(), n)
    release(spark)
    rows = counted.where("kind = 'doc'").select("doc_id", "fp", "n")
    sizes = rows.where("n > 0").select(F.col("fp").alias("node"), "n").distinct()
    groups = cut(_groups(_tie_stage(docs, orders, k, num, den), sizes, cell, cell_shingles), "ngram-groups")
    release(spark)
    links = cut(_cell_stage(docs, groups, k, num, den), "ngram-links")
    roots = components(links, "ngram-components")
    discard(groups, links)
    return salted_join(rows.withColumnRenamed("fp", "node"), roots, "node").select("doc_id", F.col("node").alias("fp"), "n", F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, cell: int = CELL, cell_shingles: int = CELL_SHINGLES, order_bits: int = ORDER_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    named = _joined(docs, k, num, den, cell, cell_shingles, order_bits)
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many")
    return salted_join(named.drop("fp"), least, "root").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "doc_id")).alias("component_id")
    )


def _row_keys(ids: np.ndarray, fps: np.ndarray) -> np.ndarray:
    return mix(fps.view(np.uint64) ^ mix(ids.view(np.uint64) + _B)).view(np.int64)


def deduplicate(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without the near copies: one row of each component stays.

    It is the one with the smallest doc_id, null ids coming last, then with the smallest
    set by fingerprint, and of rows that repeat both, that with the least text.  Rows without
    a shingle all stay.  Rows are told apart by doc_id and set, so a row that only shares
    its doc_id with a lost one stays.  Only rows that a filter of bounded size takes for
    lost or repeated are exchanged.
    """
    named = _joined(docs, k, num, den, CELL, CELL_SHINGLES, ORDER_BITS).where("n > 0")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    best = named.groupBy("root").agg(F.min(place).alias("best"), F.count("*").alias("many")).where("many > 1")
    found = salted_join(named.select("doc_id", "fp", "root"), best, "root", "inner")

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_row_keys(ints(batch.column(0)), ints(batch.column(1)))), batch.column(2)], names=["key", "stays"])

    marked = found.select("doc_id", "fp", (place == F.col("best")).alias("stays")).groupBy("doc_id", "fp").agg(F.first("stays").alias("stays"), F.count("*").alias("rows"))
    decided = cut(marked.where("not stays or rows > 1").select("doc_id", "fp", "stays").mapInArrow(keyed, "key long, stays boolean"), "ngram-decided")
    spark = docs.sparkSession
    suspects = spark.sparkContext.broadcast(bits_of(decided, "key", min(MEMBER_BITS, 1024 * buckets(spark) + 16 * decided.count())))
    name, stays = "_key", "_stays"
    while {name, stays} & set(docs.columns):
        name, stays = name + "_", stays + "_"

    def told(batches, suspect: bool):
        for batch in chunks(batches, "text"):
            fps = np.array([fingerprint(x) if len(x) else 0 for _, x in document_sets(batch, k)], np.int64)
            key = _row_keys(ints(batch.column(batch.schema.get_field_index("doc_id"))), fps)
            mask = suspects.value.has(bits_key(key))
            mask = mask if suspect else ~mask
            if mask.any():
                out = batch.filter(pa.array(mask))
                yield out.append_column(name, pa.array(key[mask])) if suspect else out

    def unsuspected(batches):
        return told(batches, False)

    def suspected(batches):
        return told(batches, True)

    shape = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{name}` long"])
    asked = salted_join(docs.mapInArrow(suspected, shape), decided.select(F.col("key").alias(name), F.col("stays").alias(stays)), name)
    again = asked.where(F.col(stays)).groupBy(name).agg(F.min_by(F.struct(*[asked[c] for c in docs.columns]), "text").alias("_row")).select("_row.*")
    return docs.mapInArrow(unsuspected, docs.schema).unionByName(asked.where(F.col(stays).isNull()).select(docs.columns)).unionByName(again)
