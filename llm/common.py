"""What the operators of this package share: the shared folder, packed exchanges,
bounded bit filters, salted joins and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.textkernel import mix, text_bytes

CHUNK_BYTES = 8 << 20
ARROW_ROWS = 2000
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def trim() -> None:
    """Give freed memory back to the system: a worker's next batch may be of another shape."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (as in tests) gets one, below the warehouse;
    on a cluster the folder could be one machine's own, so its setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut has made and no later step reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan needs."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def to_buckets(df: DataFrame, n: int) -> DataFrame:
    """Deal rows out by their column bucket (0..n-1), one bucket to a partition."""
    return df.repartitionById(n, F.col("bucket"))


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Regroup a task's batches so that each holds about limit bytes of text; no text is cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offs = text_bytes(batch.column(batch.schema.get_field_index(column)))[1]
        offs = offs.copy()  # the view would keep the bytes
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit - size, side="right")) - 1)
            held.append(batch.slice(at, to - at))
            size += int(offs[to] - offs[at])
            at = to
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                trim()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ints(column: pa.Array, null: int = -(2**63)) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    """Bucket from the high 32 bits of a hash."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that sorts by bucket, and the offsets of the buckets in it."""
    order = np.argsort(bucket.astype(np.uint16 if n < 65536 else np.int32), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))


def packed(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each range, one after the other."""
    if len(lengths) == 0 or int(lengths.sum()) == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where a new value starts in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


class Bits:
    """A filter of bits in equal segments, one per bucket, of a size bounded by its maker."""

    def __init__(self, segments: dict[int, bytes], n: int):
        self.n = n
        size = max([1, *map(len, segments.values())])
        self.bits = np.zeros((n, size), np.uint8)
        for b, s in segments.items():
            self.bits[b, : len(s)] = np.frombuffer(s, np.uint8)
        self.size = np.uint64(size * 8)

    def has(self, x: np.ndarray) -> np.ndarray:
        at = bit_position(x, self.size)
        return (self.bits[bucket_of(x, self.n), (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_position(x: np.ndarray, size: np.uint64) -> np.ndarray:
    return (mix(x & np.uint64(0xFFFFFFFF)) >> np.uint64(8)) % size


def segment(x: np.ndarray, size_bytes: int) -> bytes:
    """The bits of one bucket's hashes."""
    out = np.zeros(size_bytes * 8, bool)
    out[bit_position(x, np.uint64(size_bytes * 8)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def bits_of(df: DataFrame, column: str, max_bits: int) -> Bits:
    """A filter that holds every value of a long column.  At most max_bits bits reach the driver, whatever the rows."""
    spark = df.sparkSession
    n = buckets(spark)
    size = max(1, max_bits // 8 // n)

    def spread(batches):
        schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
        for batch in batches:
            x = np.unique(mix(ints(batch.column(0)).view(np.uint64)))
            order, at = split_by(bucket_of(x, n), n)
            rows = [(b, x[order[at[b] : at[b + 1]]].tobytes()) for b in range(n) if at[b + 1] > at[b]]
            if rows:
                yield packed(schema, rows)

    def fill(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = segment(np.frombuffer(blob, np.uint64), size)
                held[b] = bits if b not in held else np.bitwise_or(np.frombuffer(held[b], np.uint8), np.frombuffer(bits, np.uint8)).tobytes()
        if held:
            yield packed(pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]), sorted(held.items()))

    out = to_buckets(df.select(F.col(column).cast("long")).mapInArrow(spread, "bucket int, blob binary"), n).mapInArrow(fill, "bucket int, blob binary")
    return Bits({r[0]: bytes(r[1]) for r in out.collect()}, n)


def bits_key(x: np.ndarray) -> np.ndarray:
    """What Bits.has takes for values put in by bits_of."""
    return mix(x.view(np.uint64))


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join whose hot keys are split: rows of big go to one of salts copies of their row in small.

    The salt is a hash of the row, so that a task that runs again deals out the same rows.
    Spark's estimate of small knows nothing of the copies, so it never is broadcast: salts
    times a table that is taken for small, and is compressed on disk, do not fit the driver.
    """
    salt = "_salt"
    while salt in big.columns + small.columns:
        salt += "_"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[big[c] for c in big.columns]), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.hint("merge").join(right.hint("merge"), [key, salt], how).drop(salt)


def components(edges: DataFrame, name: str = "components", by: tuple[str, ...] = (), rounds: int = 60) -> DataFrame:
    """(by, node, root): the smallest node that edges (by, u, v) reach, for each node of an edge.

    Graphs of different values of by are apart.  Alternating large-star and small-star
    rounds; each round's edges go to a table in the shared folder, which takes the place of
    the last one, and only a row count and a checksum come to the driver.
    """
    by = list(by)
    e = edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut(e, name)
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
        large = both.join(low, [*by, "u"]).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(low2, [*by, "u"]).select(*by, F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        nxt = cut(small.select(*by, F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), name)
        discard(e)
        e = nxt
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(*by, F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(*by, F.col("v").alias("node"), F.col("v").alias("root")).distinct())
