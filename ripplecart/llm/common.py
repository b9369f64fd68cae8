"""Small helpers of the training-data operators: shared scratch tables and Arrow text as numpy bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds a Python worker's memory whatever the Arrow batch holds.
PASS_BYTES = 1 << 20

#: Bytes of rows that Spark hands a Python worker at once; its default of 64 MB stands in the executor and in the worker, per task.
BATCH_BYTES = 4 << 20

U64 = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one table in the cluster's shared checkpoint folder, or beside the warehouse where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    shared = shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/{name}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends here and any executor can read it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by `saved` that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers at most BATCH_BYTES at once, for operators whose rows are texts or packed arrays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tasks(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, for operators that deal rows out by a key of their own."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string()).fill_null(b"" if pa.types.is_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    at = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def offsets(col: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a column of texts, read in place."""
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32)
    return at[col.offset : col.offset + len(col) + 1].astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name, or a field of a struct column by `struct.field` (null where the struct is)."""
    if name in batch.schema.names:
        return batch.column(name)
    outer, inner = name.split(".", 1)
    return pc.struct_field(batch.column(outer), inner)


def passes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with about `most` text bytes each; a longer text is a run by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = offsets(column(batch, text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()  # workers live on and are reused


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            out = np.full(n, base, U64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end); equal bytes have equal hashes wherever they stand. Features only: see `prime_hash`."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Two primes below 2**31, so that a byte times a power and 2**24 of these sums fit 63 bits.
PRIMES = (2**31 - 1, 2**31 - 19)
_SUMS = 1 << 23
_prime_powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def prime_powers(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the first n powers of a base that the seed fixes, and of its inverse."""
    made = _prime_powers.get(seed)
    if made is None or len(made[0][0]) < n:
        made, most = [], max(n, 1 << 16)
        for i, p in enumerate(PRIMES):
            base = 2 + int(mixed(np.array([0x243F6A8885A308D3 + 2 * seed + i], U64))[0]) % (p - 3)
            both = []
            for b in (base, pow(base, -1, p)):
                out = np.ones(most, np.int64)
                have = 1
                while have < most:
                    step = min(have, most - have)
                    out[have : have + step] = out[:step] * pow(b, have, p) % p
                    have += step
                both.append(out)
            made.append((both[0], both[1]))
        _prime_powers[seed] = made
    return [(up[:n], down[:n]) for up, down in made]


def prime_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """62-bit hash of each byte span [start, end), spread over 64 bits; equal bytes have equal hashes wherever they stand.

    A polynomial modulo two primes: texts that collide whatever the base, as they exist modulo a power of two, do not
    exist here.
    """
    key = np.zeros(len(starts), U64)
    for p, (up, down) in zip(PRIMES, prime_powers(len(data) + 1, seed), strict=True):
        total, carry = np.zeros(len(data) + 1, np.int64), 0
        for at in range(0, len(data), _SUMS):
            part = np.cumsum((data[at : at + _SUMS].astype(np.int64) + 1) * up[at : min(at + _SUMS, len(data))])
            part = (part + carry) % p
            total[at + 1 : at + 1 + len(part)], carry = part, int(part[-1])
        value = (total[ends] - total[starts]) % p * down[starts] % p
        key = (key << U64(31)) + value.astype(U64)
    return mixed(key + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ..., size - 1 for each size, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def hash_share(doc_id: str) -> Column:
    """A value in [0, 1) fixed by the id, for samples."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
