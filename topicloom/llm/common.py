"""Helpers shared by the operators: words of whole texts as arrays, hashes,
intermediate tables in the cluster's shared folder, gapless numbering."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Bytes of text that a task turns into word arrays at a time (a longer text
#: is worked on whole, by itself).
SLICE_BYTES = 4 << 20
#: Rows in a batch for Python; see ``bounded_batches``.
ROWS = 1000

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


def bounded_batches(spark: SparkSession) -> None:
    """Send at most ``ROWS`` documents to Python at a time, unless the session
    says otherwise: Spark's 10,000 rows would be many times a slice, held in
    the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Consecutive (start, part) of a string array, each of at most ``limit``
    bytes or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(texts):
        yield start, texts.slice(start)
    # workers live on between stages: they give back what the batch took
    pa.default_memory_pool().release_unused()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts (null: none).

    ``codes``: the word number of every position; ``bounds``: text i holds
    positions bounds[i] to bounds[i+1]; ``vocabulary``: the distinct words.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        flat = lists.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        self.bounds = np.concatenate([[0], np.cumsum(real)])[ends].astype(np.int64)
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the word at every position."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.cast(pa.binary()).to_pylist()),
                          np.uint64, len(self.vocabulary))
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)

    def owners(self) -> np.ndarray:
        """The text number of every position."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` successive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out ^ h[k:len(h) - n + 1 + k]) + np.uint64(2 * k + 1)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only a local session (one process)
    may leave it unset; it then gets a scratch folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost
    executor's work is read again instead of computed again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the folder behind a table of ``written`` that is read no more."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Cells of a ``maybe_in`` filter: 2 MB, whatever the number of keys.
FILTER_BITS = 24


def cells_of(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Packed bits of the low ``bits`` of the one column of hashes: a filter of
    2**bits / 8 bytes, whatever their number. It has no false negatives."""
    name = hashes.columns[0]
    spot = hashes.select(F.expr(f"{name} & {(1 << bits) - 1}L").alias("_spot"))
    cells = spot.groupBy(F.shiftright("_spot", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(_spot & 63))")).alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells["cell"].to_numpy(np.int64)] = cells["set"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)


def maybe_in(shared, bits: int = FILTER_BITS):
    """hash -> whether its cell is set in the broadcast filter (null: false)."""
    @arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        h = hashes.fill_null(0).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
        hit = (shared.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1
        return pc.and_(pa.array(hit.astype(bool)), pc.is_valid(hashes))
    return test


class Tables:
    """Tables that are read only inside a with block, deleted at its end."""

    def __enter__(self):
        self.made = []
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(written(df, name))
        return self.made[-1]

    def __exit__(self, *error):
        for df in self.made:
            dropped(df)


def numbered(df: DataFrame, key: str, order: list[str], out: str, blocks: int = 64) -> DataFrame:
    """Number the rows of each ``key`` gapless from 0 (column ``out``).

    Equal rows are counted first and numbered together, each key is dealt
    over ``blocks`` blocks by the hash of its ``order`` columns, and a block
    starts where the blocks before it end: no task holds a whole key. Rows
    get the same number however often a task is repeated. Columns of ``df``
    beyond ``key`` and ``order`` are not kept.
    """
    from pyspark.sql import Window

    block = F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int")
    kinds = df.groupBy(key, *order).agg(F.count("*").alias("_copies")).withColumn("_block", block)
    sizes = kinds.groupBy(key, "_block").agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_key"), F.col("_block").alias("_b"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_copies").over(inside), F.lit(0))
    return (kinds.join(starts, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_block") == F.col("_b")), "left")
            .withColumn("_first", first)
            .withColumn(out, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)))
            .select(key, *order, out))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
