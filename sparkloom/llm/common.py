"""Pieces shared by the training-data operators: scratch tables, skew-safe joins, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Largest number of rows that is ever broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: A hot key's rows are dealt over this many tasks.
SALTS = 64

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that is an error, since executors
    couldn't see it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.loom.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.loom.scratch", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends here and a lost executor costs no recomputation.

    With `by`, an integer column, rows lie in a folder for each of its values, so that reading one value reads no other.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/loom-{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loom_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.loom_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def private(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def join_salted(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, *spread: str) -> DataFrame:
    """left LEFT JOIN right on key, where right has one row a key and `weight` says how many rows of left hold it.

    Fewer than HOT_SHARE keys can exceed total / HOT_SHARE, so that list is broadcast; rows of such keys are
    dealt over SALTS tasks by the hash of `spread`, and only those keys' rows of right are repeated. Rows without a key
    find nothing and are dealt in the same way. Up to BROADCAST_ROWS rows of left there are no more keys than that, and
    right is broadcast.
    """
    if total <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), key, "left")
    limit = max(1, total // HOT_SHARE)
    hot_name, salt_name = private(left, "hot", "salt")
    hot = right.where(F.col(weight) > limit).select(F.col(key), F.lit(True).alias(hot_name))
    dealt_left = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    salt = F.when(F.col(hot_name) | F.col(key).isNull(), dealt_left).otherwise(F.lit(0))
    copies = F.when(F.col(weight) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = right.withColumn(salt_name, F.explode(copies))
    return left.join(F.broadcast(hot), key, "left").withColumn(salt_name, salt).join(dealt, [key, salt_name], "left").drop(hot_name, salt_name, weight)


def join_small(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join with a materialised right side: broadcast if it has at most BROADCAST_ROWS rows, else shuffled."""
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, on, how)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b), both bigint; component is the least node reachable.

    Alternates large-star and small-star steps, each an aggregation and a salted join, until the edge set no longer
    changes. No adjacency list is ever collected into one row, and a hub's edges are dealt over several tasks. The table
    of one step is deleted once the next one's is written.
    """
    a, b = F.col("a"), F.col("b")
    now = staged(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = None
    while True:
        total = max(2 * now.count(), 1)
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w"))
        large = join_salted(both, low, "a", "w", total, "b").where(b > a).select(b.alias("a"), F.least(a, F.col("m")).alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w"))
        small = join_salted(large, low, "a", "w", total, "b").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        then, now = now, staged(small.distinct(), "edges")
        unstage(then)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(a.alias("node"), b.alias("component")).unionByName(now.select(b.alias("node"), b.alias("component"))).distinct()


_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Splits UTF-8 texts into words at separator bytes and hashes each word, for whole batches at a time.

    Every byte of a character outside ASCII counts as a word byte, so splitting bytes is the same as splitting
    characters. A-Z hash as a-z unless told otherwise. A word of up to SHORT bytes is hashed eight bytes at a time with
    all others; a longer one by itself.
    """

    SHORT = 64

    def __init__(self, separators: bytes, fold_case: bool = True):
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.value = np.arange(256, dtype=np.uint8)
        if fold_case:
            self.value[65:91] += 32
        self.below = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def spans(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.zeros(len(buffer) + 2, np.int8)
        word[1:-1] = ~self.sep[buffer]
        step = np.diff(word)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def hashes(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        folded = np.zeros(len(buffer) + 8, np.uint8)
        folded[: len(buffer)] = self.value[buffer]
        eight = np.ndarray((len(buffer) + 1,), "<u8", folded, strides=(1,))
        length = ends - starts
        out = mix(length.astype(np.uint64) + _M)
        todo, at, left = slice(None), starts, length
        for _ in range(0, self.SHORT, 8):
            if not len(at):
                break
            out[todo] = mix(out[todo] ^ (eight[at] & self.below[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            todo = more if isinstance(todo, slice) else todo[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > self.SHORT).tolist():
            out[i] = xxhash.xxh3_64_intdigest(folded[starts[i] : ends[i]].tobytes())
        return out

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """buffer, starts, ends, hashes of all words; bounds[i]:bounds[i + 1] are the words of text i."""
        glue = bytes([int(np.flatnonzero(self.sep)[-1])])
        buffer = np.frombuffer(glue.join(texts) + glue, np.uint8)
        starts, ends = self.spans(buffer)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        return buffer, starts, ends, self.hashes(buffer, starts, ends), np.searchsorted(starts, first)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; one of all words if there are fewer, none if there are none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = hashes[: n - width + 1].copy()
    for j in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407) + hashes[j : n - width + 1 + j]
    return mix(out + np.uint64(width))


def in_chunks(texts: list, size: int = 1 << 20):
    """(position, UTF-8 texts) of consecutive texts of about `size` bytes together; a longer text stands alone. None is empty."""
    at, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
        if held and total + len(t) > size:
            yield at, held
            at, held, total = i, [], 0
        held.append(t)
        total += len(t)
    if held:
        yield at, held


def bound_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Lower the session's Arrow batches to so many rows, if they are larger.

    Each running task holds a batch on either side of the pipe to Python; with 10,000 long texts in it that is most of a
    small executor's memory outside the heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    return spark


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that Python holds few texts at once; freed memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # workers are used again; on glibc they'd keep their peak
    if trim:
        trim(0)


def with_struct(df: DataFrame, name: str, fields: str, columns: list, make: Callable[[], Callable[..., list]], rows: int = 1000) -> DataFrame:
    """df with one more struct column, computed from `columns` in Arrow batches without any shuffle.

    make() runs once a task and gives a function from the columns' Python lists (of up to `rows` values) to one list per field. df's own columns
    pass through untouched; the struct's name must be none of theirs (see `private`).
    """
    if name in df.columns:
        raise ValueError(f"the rows have a column {name} already; choose another name")
    bound_batches(df.sparkSession)
    arguments = [c.alias(n) for c, n in zip(columns, private(df, *[f"in{i}" for i in range(len(columns))]), strict=True)]
    kind = T.StructType.fromDDL(fields)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow, inputs = to_arrow_schema(kind), len(arguments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in small(batches, rows):
            n = batch.num_columns - inputs
            made = of(*[c.to_pylist() for c in batch.columns[n:]])
            arrays = [pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)]
            struct = pa.StructArray.from_arrays(arrays, fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], struct], names=[*batch.schema.names[:n], name])

    return df.select("*", *arguments).mapInArrow(run, schema)
