"""Shared helpers: written tables, bounded broadcasts, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_table

#: ASCII white space, the word separator of every operator here; the Java and
#: RE2 spellings of "a word" follow.
WORD = r"[^\x20\x09-\x0D]+"

#: Entries a worker's word-hash cache may hold before it starts afresh.
WORD_CACHE = 300_000

#: Bytes of a batch that Spark sends to a Python operator, about; one row is never cut.
BATCH_BYTES = 8 << 20


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own: as given, with underscores in
    front until the input has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the cluster's shared checkpoint folder and read
    it back: later steps start from the files, so a lost executor never costs
    the work above them, and only the columns they use are read."""
    spark = df.sparkSession
    path = new_table(spark, "llm")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """Rows per Arrow batch for the Python operators, fewer where texts are long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Freed memory that the Arrow pool and the C library hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def tidy(run: Callable) -> Callable:
    """``run`` of a mapInArrow.  A worker stays for later tasks, so that what
    one of them has freed is given back at its end."""
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """``run`` of an applyInArrow, likewise after each group."""
    def tidied(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return tidied


def raw_text(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand, bounded."""

    def __missing__(self, word):
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(texts: list[bytes], lower: bool = True) -> Iterator[list[bytes]]:
    """Words of each text: bytes.lower() folds A-Z only and bytes.split()
    cuts at exactly the ASCII white space of ``WORD``."""
    return (t.lower().split() if lower else t.split() for t in texts)


def looked_up(words: Iterable[list[bytes]], table: dict, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(what ``table`` has for every word of every text, number of words of
    each text); the words of one text at a time are held."""
    parts = [np.fromiter(map(table.__getitem__, w), kind, count=len(w)) for w in words]
    return np.concatenate([np.zeros(0, kind), *parts]), np.fromiter(map(len, parts), np.int64, count=len(parts))


def flat_hashes(words: Iterable[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text, number of words of each text)."""
    return looked_up(words, cache, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position (the last k-1 windows
    run over the end and are for the caller to leave out)."""
    out = np.zeros(len(flat), np.uint64)
    for j in range(k):
        c = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3) | 1) & 0xFFFFFFFFFFFFFFFF)
        out[: len(flat) - j] += mix(flat[j:] * c)
    return mix(out)


def key_bitmap(keys: DataFrame, column: str, log2_bits: int = 23) -> bytes:
    """A bitmap of 2**log2_bits bits (1 MB by default, whatever the input)
    with the bit of each 64-bit key set.  A set bit may be another key's, so
    it only ever saves work; matches are confirmed by a join."""
    word = F.shiftrightunsigned(F.col(column), 64 - log2_bits)
    rows = (keys.select((F.shiftright(word, 6)).cast("int").alias("w"),
                        F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - log2_bits}) & 63 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    bits = np.zeros(1 << (log2_bits - 6), np.int64)
    for r in rows:
        bits[r["w"]] = r["b"]
    return bits.tobytes()


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray, log2_bits: int = 23) -> np.ndarray:
    """bitmap: int64 words of key_bitmap; keys: uint64."""
    word = keys >> np.uint64(64 - log2_bits)
    return (bitmap.view(np.uint64)[(word >> np.uint64(6)).astype(np.int64)] >> (word & np.uint64(63))) & np.uint64(1) == 1
