"""Token-id files: canonical length-limited Huffman coding with independent blocks.

Texts are encoded with a tokenizer of the tokenizers library and closed with an end id.
Global counts of the ids give code lengths (package-merge, at most MAX_BITS bits) and
with them canonical codes.  Documents, in ascending order of doc_id, go into blocks of
about BLOCK_TOKENS ids; a block can be decoded alone, and it has a checkpoint (a bit
offset) for every STEP ids, from which table-driven decoding runs on all lanes at once.

A file set is a folder: ``codes`` (id, length; as large as the vocabulary at most) and
``blocks``, binary files in the order of their names, written by Spark's text writer
with a line feed after each block:

    magic "HB2\\n", then little-endian: u64 ids of all documents before the block, u32
    documents, u64 ids, u64 bits, u32 STEP, i64 doc_id (documents), u8 doc_id is null (documents), u64 ids (documents),
    u64 bit offset (checkpoints), payload

Every text is tokenized once; the ids go to a table in the shared folder, which the
count, the order by doc_id and the coding start from.  Bounds between the buckets come
from a sample of the order's columns, and the ids in each bucket from one sum over sizes,
so a block knows its place before it is written and files are read once.  A file has
FILE_BLOCKS blocks at most.  Equal words (runs of bytes that
are not blanks) are encoded once per worker: the tokenizer's pre-tokens never span a
blank, which is checked on its file before words are used at all.

Defined results.  A null text is an empty one and has the end id alone.  A null doc_id
stands before every other.  Rows that repeat a doc_id are kept, ordered by the crc32 of
their ids and then by their bytes (as in the table: a byte 2 or 4, then the ids).  Other columns are ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import buckets, chunks, cut, discard, ranges, shared_dir, to_buckets
from llm.textkernel import scan_words, text_bytes

END_ID = 2
MAX_BITS = 20
BLOCK_TOKENS = 1 << 20
STEP = 256
FILE_BLOCKS = 16
SAMPLED = 40  # rows of the order's sample for each bucket
CACHE_WORDS = 500_000
_MAGIC = b"HB2\n"
_NULL = -(2**63)
_TAIL = ".,;:!?#*$%&|()-\"+=/"
_END_HASH = np.uint64(0x1F83D9ABFB41BD6B)
_workers: dict[str, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letters that byte-level tokenizers write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


_LETTERS = _byte_letters()


class WordEncoder:
    """Ids of words, kept in flat arrays; a full cache keeps the words of the rows at hand."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = json.dumps(spec.get("pre_tokenizer") or {})
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and "[^\\\\s\\\\p{L}\\\\p{N}]+" in split and '"Removed"' in split and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.model = self.tokenizer.model
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def word(self, w: str) -> list[int]:
        """A word's ids.  Letters with closing marks go to the model itself, as they are one pre-token each."""
        stem = w.rstrip(_TAIL)
        if stem.isalpha() and len(stem) < 200:
            low = stem.lower()
            if low.isascii():
                ids = [t.id for t in self.model.tokenize(low)]
            elif low.isalpha() and len(low) == len(stem) and "ς" not in low and unicodedata.is_normalized("NFC", stem):
                ids = [t.id for t in self.model.tokenize("".join(_LETTERS[b] for b in low.encode()))]
            else:
                return self.tokenizer.encode(w, add_special_tokens=False).ids
            return ids + [t.id for t in self.model.tokenize(w[len(stem) :])] if len(stem) < len(w) else ids
        return self.tokenizer.encode(w, add_special_tokens=False).ids

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [self.word(w) for w in words]
        sizes = np.concatenate((np.diff(self.at), np.fromiter(map(len, found), np.int64, len(found))))
        flat = np.concatenate((self.ids, np.fromiter((i for f in found for i in f), np.uint32)))
        starts = np.cumsum(sizes) - sizes
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known, sizes = known[order], sizes[order]
        self.ids = flat[ranges(starts[order], sizes)]
        self.at = np.concatenate(([0], np.cumsum(sizes)))

    def keep(self, words: np.ndarray) -> None:
        """Only these words, given by their places in ascending order, stay."""
        sizes = np.diff(self.at)[words]
        self.known, self.ids = self.known[words], self.ids[ranges(self.at[words], sizes)]
        self.at = np.concatenate(([0], np.cumsum(sizes)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with their end ids, offsets by row)."""
        rows = len(column)
        if not self.by_word:
            found = [e.ids + [END_ID] for e in self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for f in found for i in f), np.uint32), np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
        data, offs = text_bytes(column)
        starts, ends, h, at = scan_words(data, offs)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, u)
        missing = np.ones(len(u), bool)
        inside = place < len(self.known)
        missing[inside] = self.known[place[inside]] != u[inside]
        if missing.any():
            raw = data.tobytes()
            if len(self.known) + int(missing.sum()) > CACHE_WORDS:
                self.keep(place[~missing])
            i = first[missing]
            self.add(u[missing], [raw[a:b].decode("utf-8") for a, b in zip(starts[i].tolist(), ends[i].tolist())])
            place = np.searchsorted(self.known, u)
        begin, size = self.at[place][inverse], np.diff(self.at)[place][inverse] if len(u) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        row_at = total[at] + np.arange(rows + 1)
        out = np.full(int(row_at[-1]), END_ID, np.uint32)
        keep = np.ones(len(out), bool)
        keep[row_at[1:] - 1] = False
        out[keep] = self.ids[ranges(begin, size)]
        return out, row_at


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def tokenize(docs: DataFrame, tokenizer: str, *order: str) -> DataFrame:
    """(doc_id, ids, n) of each row and the columns named in order.

    ids are a byte 2 and little-endian unsigned 16-bit integers, or a byte 4 and 32-bit ones; n counts them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *order)
    shape = ", ".join(["doc_id long", "ids binary", "n long", *(f"`{c}` {t}" for c, t in rows.dtypes[2:])])

    def apply(batches):
        for batch in chunks(batches, "text", 4 << 20):
            ids, at = encoder(tokenizer).encode(batch.column(1))
            wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
            flat = ids if wide else ids.astype(np.uint16)
            blobs = [(b"\x04" if wide else b"\x02") + flat[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(np.diff(at)), *batch.columns[2:]], names=["doc_id", "ids", "n", *order])

    return rows.mapInArrow(apply, shape)


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint16 if blob[0] == 2 else np.uint32, -1, 1)


def count_ids(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over all rows: as many as the vocabulary has at most."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                c = np.bincount(_ids(blob))
                if len(c) > len(total):
                    total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                total[: len(c)] += c
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["id", "n"])

    return [(r[0], r[1]) for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()]


def code_lengths(counts: list[tuple[int, int]], limit: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most limit bits, by package-merge."""
    if not counts:
        return {}
    if len(counts) == 1:
        return {counts[0][0]: 1}
    if len(counts) > 1 << limit:
        raise ValueError("more ids than codes")
    counts = sorted(counts, key=lambda c: (c[1], c[0]))
    weight = np.array([c[1] for c in counts], np.float64)
    n = len(weight)
    lists = [np.ones(n, bool)]
    level = weight
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((weight, pairs))
        order = np.argsort(merged, kind="stable")
        level = merged[order]
        lists.append(order < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * (n - 1)
    for single in reversed(lists):
        k = int(single[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    return {c[0]: int(x) for c, x in zip(counts, lengths)}


class Codes:
    """Canonical codes from lengths, and the table that decodes them."""

    def __init__(self, lengths: dict[int, int]):
        self.limit = max(lengths.values(), default=1)
        size = max(lengths, default=0) + 1
        self.length = np.zeros(size, np.int64)
        self.code = np.zeros(size, np.uint64)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.used = np.ones(1 << self.limit, np.int64)
        code, last = 0, 0
        for symbol in sorted(lengths, key=lambda s: (lengths[s], s)):
            bits = lengths[symbol]
            code <<= bits - last
            last = bits
            self.length[symbol], self.code[symbol] = bits, code
            span = slice(code << (self.limit - bits), (code + 1) << (self.limit - bits))
            self.symbol[span], self.used[span] = symbol, bits
            code += 1

    def pack(self, ids: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """(payload, bits, bit offset of every STEPth id)."""
        size = self.length[ids]
        end = np.cumsum(size)
        at = end - size
        bits = int(end[-1]) if len(end) else 0
        word, off = at >> 6, at & 63
        room = 64 - off - size
        code = self.code[ids]
        over = np.flatnonzero(room < 0)
        here = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        out = np.zeros((bits + 63) // 64 + 1, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[first]] = np.add.reduceat(here, first)
            out[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (bits + 7) // 8], bits, at[::STEP]

    def unpack(self, payload: bytes, n: int, checkpoints: np.ndarray, step: int) -> np.ndarray:
        """The n ids of a block, decoded from all checkpoints side by side."""
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        out = np.zeros(len(checkpoints) * step, np.uint32).reshape(len(checkpoints), step)
        at = checkpoints.astype(np.int64)
        top = (len(payload) + 4) * 8
        mask = np.uint32((1 << self.limit) - 1)
        for j in range(min(step, n)):
            i = at >> 3
            four = (data[i] << np.uint32(24)) | (data[i + 1] << np.uint32(16)) | (data[i + 2] << np.uint32(8)) | data[i + 3]
            peek = (four >> (32 - self.limit - (at & 7)).astype(np.uint32)) & mask
            out[:, j] = self.symbol[peek]
            at = np.minimum(at + self.used[peek], top - 32)
        return out.reshape(-1)[:n]


def block(docs: list[tuple[int | None, np.ndarray]], codes: Codes, start: int) -> bytes:
    ids = np.concatenate([d[1] for d in docs]).astype(np.int64)
    payload, bits, checks = codes.pack(ids)
    n = len(docs)
    return b"".join((
        _MAGIC, struct.pack("<QIQQI", start, n, len(ids), bits, STEP), np.array([_NULL if d[0] is None else d[0] for d in docs], "<i8").tobytes(),
        np.array([d[0] is None for d in docs], np.uint8).tobytes(), np.array([len(d[1]) for d in docs], "<u8").tobytes(), checks.astype("<u8").tobytes(), payload,
    ))


def blocks(content: bytes):
    """(ids before, ids, doc_ids, nulls, sizes, checkpoints, step, payload) of each block of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != _MAGIC:
            raise ValueError("not a block")
        start, n, total, bits, step = struct.unpack_from("<QIQQI", content, at + 4)
        at += 36
        parts = []
        for kind, many in (("<i8", n), (np.uint8, n), ("<u8", n), ("<u8", -(-total // step))):
            parts.append(np.frombuffer(content, kind, many, at))
            at += parts[-1].nbytes
        size = (bits + 7) // 8
        yield start, total, *parts, step, content[at : at + size]
        at += size + 1


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write docs (doc_id, text) as a file set in ascending order of doc_id."""
    tokens = cut(tokenize(docs, tokenizer), "tokens")
    write_tokens(tokens.withColumn("crc", F.crc32("ids")), path, "doc_id", "crc")
    discard(tokens)


def _bucket(tokens: DataFrame, order: tuple[str, ...], n: int) -> Column:
    """The bucket, 0 to n - 1, of a row by its place in the order; null stands first."""
    some = min(1.0, SAMPLED * n / max(1, tokens.count()))
    found = sorted({tuple(r) for r in tokens.select(*order).sample(some, 17).collect()}, key=lambda r: [(x is not None, x) for x in r])
    bounds = [found[i * len(found) // n] for i in range(1, n)] if found else []
    shape = tokens.select(*order).schema.simpleString()
    listed = F.from_json(F.lit(json.dumps([dict(zip(order, b)) for b in bounds])), f"array<{shape}>")
    return F.size(F.filter(listed, lambda b: b <= F.struct(*order)))


def write_tokens(tokens: DataFrame, path: str, *order: str) -> None:
    """Write tokens (doc_id, ids, n and the columns of order) as a file set in that order."""
    spark = tokens.sparkSession
    n = buckets(spark)
    lengths = code_lengths(count_ids(tokens))
    table = spark.range(0).selectExpr("id", "cast(id as int) length") if not lengths else spark.createDataFrame(pa.table({"id": pa.array(list(lengths), pa.int64()), "length": pa.array(list(lengths.values()), pa.int32())}))
    table.coalesce(1).write.parquet(f"{path}/codes")
    placed = tokens.withColumn("bucket", _bucket(tokens, order, n))
    held = np.zeros(n, np.int64)
    for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        held[r["bucket"]] = r["n"]
    shared = spark.sparkContext.broadcast((Codes(lengths), np.cumsum(held) - held))

    def build(batches):
        codes, starts = shared.value
        held, size, start = [], 0, None
        for batch in batches:
            for b, doc, blob in zip(*(c.to_pylist() for c in batch.columns)):
                start = int(starts[b]) if start is None else start
                ids = _ids(blob)
                held.append((doc, ids))
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array([block(held, codes, start)], pa.binary())], names=["block"])
                    held, size, start = [], 0, start + size
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block(held, codes, start)], pa.binary())], names=["block"])

    ordered = to_buckets(placed, n).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order), "ids").select("bucket", "doc_id", "ids")
    lines = ordered.mapInArrow(build, "block binary").select(F.col("block").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of a file set; ids are little-endian unsigned 32-bit integers."""
    codes = spark.sparkContext.broadcast(Codes({r[0]: r[1] for r in spark.read.parquet(f"{path}/codes").collect()}))
    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("content")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                for start, many, ids, null, size, checks, step, payload in blocks(content.as_py()):
                    flat = codes.value.unpack(payload, many, checks, step)
                    ends = np.cumsum(size.astype(np.int64))
                    begin = ends - size.astype(np.int64)
                    blobs = [flat[a:z].tobytes() for a, z in zip(begin.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null > 0), pa.array(begin + start), pa.array(size.astype(np.int64)), pa.array(blobs, pa.binary())], schema=schema)

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_dir(docs.sparkSession, "token-files")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
