"""Quality classifier from supervised subword embeddings.

Each word and each run of 1 to 3 characters (code points) inside a word is hashed to one
of BUCKETS embeddings of DIM numbers, and pairs of equal neighbouring words share one; a
document is their average, and a softmax over two classes gives the score.  Embeddings and
softmax are learned by numpy stochastic gradient descent on a bounded sample: of the
labels whose crc32(doc_id as text) mod 4 is not 2, the first SAMPLE in the order of a hash
of doc_id; of their documents, the first SAMPLE rows in that order that keep within
SAMPLE_BYTES of text together (a text that would not fit is passed over, never cut).  Only
text is an input.

As average and softmax are linear, scoring needs one number for each bucket: the model
that goes to the workers has a fixed size.

Defined results.  A null or blank text has the score of the bias alone.  Null doc_ids
are scored, are not held out unless crc32 of the empty text says so, and are never
trained on; null qualities are left out; several labels of a document count each.
Without any label the score is 0.5.  Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import chunks, ints
from llm.textkernel import _DOWN, _P, _TABLES, _UP, _WINDOW, SPACE, mix, scan_words, text_bytes

BUCKETS = 1 << 18
DIM = 8
SAMPLE = 4000
SAMPLE_BYTES = 64 << 20
EPOCHS = 5
RATE = 0.5
GRAMS = (1, 2, 3)
AGAIN = 5  # the bucket of a word pair whose words are equal
SEED = 11
THRESHOLD = 0.7


def features(data: np.ndarray):
    """(place, end, bucket) of each run of characters that holds no blank; data may hold several rows."""
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    table = _TABLES[False]
    for at in range(0, len(begins) - 1, _WINDOW // 4 - 8):
        edge = begins[at : at + _WINDOW // 4 + 1]  # characters have at most four bytes
        piece = data[edge[0] : edge[-1]]
        m, first = len(piece), edge - edge[0]
        acc = np.zeros(m + 1, np.uint64)
        np.cumsum(table[piece] * _UP[:m], out=acc[1:])
        blank = np.concatenate(([0], np.cumsum(SPACE[piece])))
        last = at + len(edge) == len(begins)
        for g in GRAMS:
            a, z = first[:-g], first[g:]
            if not last:  # runs that start in the overlap belong to the next window
                a, z = a[: _WINDOW // 4 - 8], z[: _WINDOW // 4 - 8]
            inside = blank[z] == blank[a]
            a, z = a[inside], z[inside]
            h = mix((acc[z] - acc[a]) * _DOWN[a] + np.uint64(g << 8))
            yield edge[0] + a, edge[0] + z, (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        if last:
            return


def document_features(texts: pa.Array):
    """(row, bucket) of each feature: words, pairs of equal words and runs of characters."""
    data, offs = text_bytes(texts)
    _, _, h, at = scan_words(data, offs)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    rows, buckets = [row, row[again]], [(mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64), np.full(len(again), AGAIN)]
    for place, end, bucket in features(data):
        row = np.searchsorted(offs, place, side="right") - 1
        inside = end <= offs[row + 1]
        rows.append(row[inside])
        buckets.append(bucket[inside])
    return np.concatenate(rows), np.concatenate(buckets)


def train(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): the log-odds of class 1 are the mean weight of a text's features and the bias."""
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    docs = []
    for at in range(0, len(texts), 64):
        row, bucket = document_features(pa.array(texts[at : at + 64], pa.string()))
        order = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[order], np.arange(len(texts[at : at + 64]) + 1))
        docs += [np.unique(bucket[order[a:b]], return_counts=True) for a, b in zip(edges[:-1], edges[1:])]
    steps = max(1, EPOCHS * len(docs))
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            bucket, many = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (many / max(1, many.sum())).astype(np.float32)
            hidden = share @ embed[bucket] if len(bucket) else np.zeros(DIM, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * 0.1 * p
            if len(bucket):
                embed[bucket] -= rate * min(len(bucket), 50) * share[:, None] * back[None, :]
    return (embed @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Train on the bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_quality"))
    known = known.where("doc_id is not null and _quality in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    named = rows.select("doc_id", "_quality", "text", F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("name"), F.octet_length("text").alias("size"))
    # sizes first: at most sample short rows reach the driver
    sizes = named.select("place", "doc_id", "_quality", "name", "size").orderBy("place", "doc_id", "_quality", "name").limit(sample).collect()
    taken, total = {}, 0
    for r in sizes:
        if total + r["size"] <= sample_bytes:
            total += r["size"]
            key = (r["doc_id"], r["_quality"], r["name"])
            taken[key] = taken.get(key, 0) + 1
    if not taken:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame(list(taken), "doc_id long, _quality int, name long")
    # equal rows come once, and as often as they were taken into the training
    texts = named.join(F.broadcast(wanted), ["doc_id", "_quality", "name"]).groupBy("doc_id", "_quality", "name").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["doc_id"], r["_quality"], r["name"], r["text"]) for r in texts)
    rows = [r for r in rows for _ in range(taken[r[:3]])]
    return train([r[3] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, sample, sample_bytes))

    def apply(batches):
        weight, bias = model.value
        for batch in chunks(batches, "text", 2 << 20):
            row, bucket = document_features(batch.column(1))
            n = batch.num_rows
            total = np.bincount(row, weights=weight[bucket], minlength=n)
            many = np.maximum(1, np.bincount(row, minlength=n))
            value = 1 / (1 + np.exp(-(total / many + bias)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(value)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, score double")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
