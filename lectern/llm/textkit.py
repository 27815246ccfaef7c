"""Vectorised text primitives shared by the training-data operators.

Everything here works on the raw buffers of Arrow string arrays: words are found and hashed for a whole
batch with numpy, in short stretches that stay in the cache, so memory stays bounded however long one text is.
"""

from __future__ import annotations

import ctypes
import gc
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_dir

CHUNK = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"
_ORDER = np.arange(256, dtype=np.uint8)


def _table(inside) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


#: A-Z to a-z, other bytes as they are
LOWER = np.where((_ORDER >= 65) & (_ORDER <= 90), _ORDER + 32, _ORDER).astype(np.uint8)
LOWER_BYTES = LOWER.tobytes()
#: bytes of words that end only at ASCII white space
NON_SPACE = ~_table(WHITE)
#: bytes of words made of ASCII letters and digits and everything beyond ASCII
ALNUM = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])

#: bytes that are hashed at a time
WORK = 1 << 17
_rng = np.random.Generator(np.random.PCG64(20_26))
#: one random 64-bit value for each byte, the same for A-Z and a-z
_VALUES = (_rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[LOWER]
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64; those of a usual stretch are kept."""
    if base not in _powers:
        _powers[base] = np.full(4 * WORK, base, np.uint64)
        _powers[base][0] = 1
        np.multiply.accumulate(_powers[base], out=_powers[base])
    kept = _powers[base]
    if n <= len(kept):
        return kept[:n]
    with np.errstate(over="ignore"):
        far = np.full(-(-n // len(kept)), pow(base, len(kept), 1 << 64), np.uint64)
        far[0] = 1
        return np.multiply.outer(np.multiply.accumulate(far), kept).ravel()[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK):
    """The rows of a batch in runs of at most ``limit`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def _cuts(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> list[int]:
    """Places about WORK apart at which no word is cut."""
    cuts, at, n = [0], 0, len(raw)
    while n - at > 2 * WORK:
        to = at + WORK
        while to < n:
            gap = np.flatnonzero(~inside[raw[to : to + 65536]])
            if len(gap):
                to += int(gap[0])
                break
            to += 65536
        bound = off[np.searchsorted(off, at + WORK)] if off[-1] > at + WORK else n
        at = int(min(to, max(bound, at + WORK), n))
        cuts.append(at)
    if cuts[-1] != n:
        cuts.append(n)
    return cuts


def words(raw: np.ndarray, off: np.ndarray, inside: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (byte offsets) of each word, A-Z lower-cased, and the word offsets of the rows.

    A word's hash is the polynomial of its bytes' values modulo 2**64, from running sums over a stretch of text, mixed.
    """
    hashes, begins, finishes = [], [], []
    cuts = _cuts(raw, off, inside)
    value = np.where(inside, _VALUES, np.uint64(0))
    with np.errstate(over="ignore"):
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = raw[a:b]
            sums = value[part]
            word = np.zeros(b - a + 2, bool)
            np.not_equal(sums, 0, out=word[1:-1])
            turn = word[1:] != word[:-1]
            first, last = turn[:-1] & word[1:-1], turn[1:] & word[1:-1]
            own = off[np.searchsorted(off, a) : np.searchsorted(off, b)] - a
            first[own] = word[own + 1]
            before = own[own > 0] - 1
            last[before] = word[before + 1]
            begin, end = np.flatnonzero(first), np.flatnonzero(last)
            if not len(begin):
                continue
            sums *= _power(_BASE, b - a)
            np.cumsum(sums, out=sums)
            h = sums[end]
            h[1:] -= sums[begin[1:] - 1]
            if begin[0]:
                h[0] -= sums[begin[0] - 1]
            hashes.append(mix(h * _power(_INVERSE, b - a)[begin]))
            begins.append(begin + a)
            finishes.append(end + a + 1)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), begin, np.concatenate(finishes), np.searchsorted(begin, off)


def phrase_hash(phrase: str, inside: np.ndarray = NON_SPACE) -> np.ndarray:
    raw = np.frombuffer(phrase.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), inside)[0]


def shingles(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each row and their offsets; a shorter row gives its whole sequence as one."""
    count = np.diff(off)
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(per)), per)
    start = off[row] + (np.arange(out[-1]) - out[row])
    short = (count < n)[row]
    acc = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            there = ~short | (k < count[row])
            at = np.minimum(start + k, max(len(h) - 1, 0))
            word = h[at] if len(h) else acc
            acc = np.where(there, mix(acc * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k + 1)), acc)
    return acc, out


_folders: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    _folders.append(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def forget(*frames: DataFrame) -> None:
    """Deletes what ``written`` wrote for these frames. Nothing that still depends on them may be evaluated afterwards."""
    for df in frames:
        path = df.__dict__.pop("written_to", None)
        if path in _folders:
            _folders.remove(path)
            _delete(df.sparkSession, path)


class Sweep:
    """Deletes, at the end of a ``with`` block, what ``written`` wrote in it, but for the frame that is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, None

    def __enter__(self) -> Sweep:
        self.before = len(_folders)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept = df.__dict__.get("written_to")
        return df

    def __exit__(self, *_) -> None:
        for path in _folders[self.before :]:
            if path != self.kept:
                _folders.remove(path)
                _delete(self.spark, path)


def evenly(df: DataFrame, place, n: int, most: int = 4096) -> DataFrame:
    """Rows dealt to n partitions by a number below n, one partition a number; beyond ``most`` by its hash."""
    if not 1 < n <= most:
        return df.repartition(n, place)
    spark, found, tried = df.sparkSession, {}, 16 * n
    while len(found) < n:
        rows = spark.range(tried).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
        found, tried = {r["p"]: r["id"] for r in rows}, tried * 4
    keys = F.array(*[F.lit(found[k]).cast("long") for k in range(n)])
    return df.repartition(n, F.element_at(keys, (place + 1).cast("int")))


def trim() -> None:
    """Gives freed pages back to the system, where the libraries can: arrays of a few megabytes stay in their heaps else."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def lean(run):
    """A function of batches that trims its worker's memory when a task is done, as workers wait for others beside new ones."""

    @wraps(run)
    def out(batches):
        yield from run(batches)
        trim()

    return out


def trim_jvm(spark: SparkSession) -> None:
    """Has the driver's JVM give freed pages of its C heaps back to the system, where it can (HotSpot from 17.0.9 on): planning many steps leaves them scattered."""
    sc = spark.sparkContext
    jvm, new = sc._jvm, sc._gateway.new_array
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    types, args = new(jvm.java.lang.Class, len(kinds)), new(jvm.java.lang.Object, len(kinds))
    for i, kind in enumerate(kinds):
        types[i] = jvm.java.lang.Class.forName(kind)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with suppress(Py4JJavaError):
        # by the public interface: the server's own class is not open to reflection
        jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so when the driver's garbage is collected, else after half an hour."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def crc_mod(column: str, k: int) -> Column:
    """crc32 of the column as text, modulo k; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % k


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows whose count is so large that at most ``limit`` rows have as much, by steps of a sixteenth of a power of two.

    The threshold comes from a histogram of a few hundred rows, so no task sends its own top rows anywhere.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16)
    total, least = 0, None
    for r in df.filter(F.col(count) > 0).groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        total += r["count"]
        if total > limit:
            break
        least = r["s"]
    return df.filter(F.lit(False)) if least is None else df.filter((F.col(count) > 0) & (step >= least))
