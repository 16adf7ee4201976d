"""What the training-data operators share: scratch tables, word splitting, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 1 for the six ASCII white-space bytes that end a word: [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: A-Z to a-z; every other ASCII byte but 0-9 and a-z to a blank; bytes from 0x80 stay.
NORMAL_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: A-Z to a-z, all else as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where it is unset, only a local session gets a temporary folder of its own: on a
    cluster a machine-local folder would lose rows, so that raises instead.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/ledgerloom-{sc.applicationId}"


class Scratch:
    """Parquet tables in the shared folder. They cut lineage: rows are computed once and
    outlive the executors that made them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        self.names.append(name)
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.remove(name)

    def drop_all_but(self, *names: str) -> None:
        """Deletes all tables but those that a result still reads."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this application has put into the shared folder. For when their
    results have been written: what reads them lazily can't be run again afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc32_of_id(id_col: Column | str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")), "utf-8"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: What this worker keeps between tasks of one operator: models and caches.
_KEPT: dict[str, object] = {}
_OWNER: list[str] = [""]


def give_back() -> None:
    """Returns the memory that Python and Arrow no longer use to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(owner: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """fn as a task that leaves little behind: workers serve many queries one after another, so
    what another operator has kept goes before the task, and free memory is given back after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _OWNER[0] != owner:
            _KEPT.clear()
            _OWNER[0] = owner
            give_back()
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def kept(key: str, make: Callable[[], object], slot: str = "") -> object:
    """What make gives, once for each key; another key takes the place of the last one of its slot."""
    if _KEPT.get(slot + "/key") != key:
        _KEPT.pop(slot, None)
        _KEPT[slot] = make()
        _KEPT[slot + "/key"] = key
    return _KEPT[slot]


def loaded(key: str, sent, make: Callable[[object], object], slot: str = "") -> object:
    """What make gives for a broadcast value, kept as above; the value as sent is not kept beside it."""

    def build() -> object:
        out = make(sent.value)
        sent.__dict__.pop("_value", None)
        return out

    return kept(key, build, slot)


#: Bytes of text that a task works on at a time, unless a single text is longer.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of `rows` rows and `most` bytes of the column at most, but a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + most, "right")), at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def fresh(taken: list[str], name: str) -> str:
    """name, or a longer one that no column has, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def with_struct(docs: DataFrame, owner: str, text_col: str, into: str, kind: T.StructType, fn: Callable[[list[bytes]], list[pa.Array]], most: int = SLICE_BYTES) -> DataFrame:
    """All columns of docs as they are, and the struct `into` of what fn gives for the texts (null
    is the empty one). Rows stay where they are, so that no id is needed to bring the two together."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    sent = docs.select(*(docs[f"`{c}`"].cast("string").alias(n) if c == text_col else docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names)))
    at = docs.columns.index(text_col)
    own = T.StructType([*sent.schema, T.StructField("_out", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, most):
                out = pa.StructArray.from_arrays(fn(as_bytes(part.column(at))), names=kind.fieldNames())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, "_out"])

    made = sent.mapInArrow(tidy(owner, run), own)
    return made.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)), F.col("_out").alias(into))


def key_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """docs as (doc_id long, text) with one row for each id, and the key table where the ids had to
    be numbered: _id, _digest of the text, doc_id, and n, the number of its rows. That is so where
    they are no whole numbers or where rows share one; numbers follow the order of (id,
    digest). Rows with a null id all stay."""
    from ..operators.order import with_rank

    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        shared = plain.where("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not shared:
            return plain.select(F.col("_id").cast("long").alias("doc_id"), "text"), None
    scratch = Scratch(docs.sparkSession, "keys")
    named = plain.withColumn("_digest", F.sha2(F.encode("text", "utf-8"), 256))
    pairs = scratch.save(named.where("_id IS NOT NULL").groupBy("_id", "_digest").agg(F.count("*").alias("n")), "pairs")
    keys = scratch.save(with_rank(pairs, ["_id", "_digest"], "doc_id"), "keys")
    once = named.where("_id IS NOT NULL").dropDuplicates(["_id", "_digest"]).join(keys, ["_id", "_digest"]).select("doc_id", "text")
    return once.unionByName(plain.where("_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text")), keys


def left_join(left: DataFrame, right: DataFrame, key: str, right_key: str, spread: str) -> DataFrame:
    """left with right's columns where the keys are equal. Rows with a null key, which have no match, are
    spread by a hash of the column `spread` and not dealt to one task."""
    null = F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))
    own = right.withColumn("_zero", F.lit(0).cast("long"))
    return left.withColumn("_null", null).join(own, (F.col(key) == F.col(right_key)) & (F.col("_null") == F.col("_zero")), "left").drop("_null", "_zero")


#: Bits of a sieve: its size is fixed, whatever the number of ids.
SIEVE_BITS = 1 << 25


def sieve_of(ids: DataFrame):
    """A broadcast bitmap (4 MB) of hashes of the one column of ids: rows that it lacks have none of
    them, so that only the others need a join. With many more ids than bits it lets all pass."""
    at = F.pmod(F.xxhash64(ids.columns[0]), F.lit(SIEVE_BITS))
    words = ids.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got, table = words.toArrow(), np.zeros(SIEVE_BITS // 64, np.int64)  # as many rows as the bitmap has words, at most
    table[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return ids.sparkSession.sparkContext.broadcast(table)


def sifted(table: np.ndarray, hashes: pa.Array) -> np.ndarray:
    """Which of the hashes (xxhash64 of an id; null is none) the sieve may have."""
    at = np.mod(pc.fill_null(hashes, 0).to_numpy(zero_copy_only=False), SIEVE_BITS)
    return hashes.is_valid().to_numpy(zero_copy_only=False) & ((table[at >> 6] >> (at & 63) & 1) != 0)


def may_hold(sieve, id_col: Column) -> Column:
    """Whether a row's id may be one of the sieve's. Only the hash of the id goes to Python."""
    look = F.arrow_udf(lambda h: pa.array(sifted(sieve.value, h)), "boolean")
    return look(F.when(id_col.isNotNull(), F.xxhash64(id_col)))


def whole_ids(docs: DataFrame, id_col: str) -> Column:
    """The ids as longs, where they are compared as numbers; ids of other types are an error, as a
    cast would lose them."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    return F.col(id_col).cast("long").alias("doc_id")


def map_batches(df: DataFrame, owner: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over slices of each Arrow batch by its second column; one that gives None adds no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = fn(part)
                if out is not None:
                    yield out

    return df.mapInArrow(tidy(owner, run), schema)


def text_bytes(rows: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: sizes the buckets that depend on the input."""
    return int(rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


class WordHash(dict):
    """64-bit hash of a word, kept per worker; starts anew when it holds too many words."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


#: Odd multipliers (fixed values: the 64-bit golden ratio and the two splitmix64 constants).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64, modulo 2^64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (what the six ASCII blanks part), and how many words each text has.

    A word's bytes are taken eight at a time, for all words together."""
    raw = b" ".join(texts) + b" " * 9
    codes = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], _IS_SPACE[codes]))
    change = np.flatnonzero(space[1:] != space[:-1])
    starts, sizes = change[::2], change[1::2] - change[::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    eights = np.ndarray(len(raw) - 8, "<u8", raw, strides=(1,))
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    start = (seed * GOLDEN + MIX_A) & 0xFFFFFFFFFFFFFFFF
    h = mix64(sizes.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(start))
    at, live = 0, np.arange(len(starts))
    while len(live):
        left = sizes[live] - at
        part = eights[starts[live] + at] & (most >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        h[live] = mix64(h[live] * np.uint64(MIX_B) + part)
        at += 8
        live = live[(left > 8) & (sizes[live] <= LONG_WORD)]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + sizes[i]], seed)
    return h, counts


def chain_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive entries; entry i stands for h[i : i + width]."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix64(h[:n] + np.uint64(GOLDEN))
    for k in range(1, width):
        out = mix64(out * np.uint64(MIX_B) + h[k : k + n])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets: where each text's entries begin, and the end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def stable_seed(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())
