"""Exact duplicates by an extendible-hash index on shared files.

One scan normalises every text and chains equal texts of an Arrow batch together, comparing bytes; the rows
go to shared files: one *entry* per distinct text of a batch, with the row that would stay, and a small
member row for each document. The directory starts with one bucket and doubles while a bucket holds more
bytes than its capacity, reading only the histogram of key prefixes. Owner tasks take the buckets, contiguous key
ranges, in key order; under one key they chain the texts that differ and compare bytes, so equal hashes of
different texts never merge.

A text that fills a third of the corpus reaches its owner as one entry per batch, not one per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplecart.llm.common import passes, saved

SPACE = b" \t\n\x0b\x0c\r"
#: Key bits of the histogram that the directory reads: its deepest level.
DEPTH = 16
#: Entry bytes of a bucket before it splits.
CAPACITY = 16 << 20


def _row_schema(docs: DataFrame) -> T.StructType:
    return T.StructType(
        [T.StructField(n, t) for n, t in (("rid", T.LongType()), ("doc_id", T.LongType()), ("entry", T.LongType()), ("key", T.LongType()), ("cps", T.LongType()), ("members", T.LongType()), ("bytes", T.LongType()))]
        + [T.StructField("row", docs.schema)]
    )


def _better(a: tuple, b: tuple) -> bool:
    """Whether candidate a = (code points, doc_id, rid) stays rather than b; a null doc_id comes last."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def _index(text: str, doc_id: str):
    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in passes(batches, text, 16 << 20):
            texts = batch.column(text).cast(pa.large_binary()).to_pylist()
            ids = batch.column(doc_id).to_pylist()
            cps = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
            chains: dict[int, list[list]] = {}
            keys, mine = [], []
            for i, raw in enumerate(texts):
                norm = (raw or b"").translate(None, SPACE)
                keys.append(key := xxhash.xxh3_64_intdigest(norm))
                for one in (chain := chains.setdefault(key, [])):
                    if one[0] == norm:
                        one[2] += 1
                        if _better((cps[i], ids[i], i), one[1]):
                            one[1] = (cps[i], ids[i], i)
                        break
                else:
                    chain.append(one := [norm, (cps[i], ids[i], i), 1])
                mine.append(one)
            best = np.array([one[1][2] for one in mine], np.int64)
            head = best == np.arange(len(best))
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema), mask=pa.array(~head))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid + np.arange(len(best))), pa.array(ids, pa.int64()), pa.array(rid + best),
                    pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(cps, pa.int64()),
                    pa.array([one[2] if h else 0 for one, h in zip(mine, head, strict=True)], pa.int64()),
                    pa.array([len(one[0]) + 200 if h else 0 for one, h in zip(mine, head, strict=True)], pa.int64()), row,
                ],
                names=["rid", "doc_id", "entry", "key", "cps", "members", "bytes", "row"],
            )
            rid += len(best)

    return chained


def directory(sizes: dict[int, int], capacity: int = CAPACITY, depth: int = DEPTH) -> np.ndarray:
    """Bucket number of each directory slot, from the bytes under each key prefix of `depth` bits.

    The directory starts at depth 0 and doubles until no bucket is overfull or the prefixes are used up; buckets
    that are not overfull keep their local depth and span several slots. Numbers ascend with the key.
    """
    load = np.zeros(1 << depth, np.int64)
    for prefix, size in sizes.items():
        load[prefix] = size
    total = np.concatenate(([0], np.cumsum(load)))
    buckets, level = [(0, 0)], 0  # (local depth, prefix)
    while level < depth:
        level += 1
        split = []
        for at, prefix in buckets:
            width = 1 << (depth - at)
            over = total[(prefix + 1) * width] - total[prefix * width] > capacity
            split += [(at + 1, 2 * prefix), (at + 1, 2 * prefix + 1)] if over and at == level - 1 else [(at, prefix)]
        if len(split) == len(buckets):
            break
        buckets = split
    deep = max(at for at, _ in buckets)
    out = np.zeros(1 << deep, np.int64)
    for n, (at, prefix) in enumerate(sorted(buckets, key=lambda b: b[1] << (depth - b[0]))):
        width = 1 << (deep - at)
        out[prefix * width : (prefix + 1) * width] = n
    return out


def _owner(text: str, kept_rows: bool, schema: pa.Schema):
    """Owner task over (key, rid, doc_id, cps, members, row) in key order."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain, out, waiting = None, [], [], 0

        def flush():
            nonlocal out, waiting
            if kept_rows:
                made = [pa.RecordBatch.from_struct_array(pa.concat_arrays(out))] if out else []
            else:
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                made = [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)] if out else []
            out, waiting = [], 0
            return made

        def close():
            nonlocal waiting
            for norm, best, size, entries, row in chain:
                if kept_rows:
                    out.append(row)
                else:
                    sha = hashlib.sha256(norm).hexdigest()
                    out.extend((e, best[1], best[2], size, sha) for e in entries)
                waiting += len(norm) + 100 * len(entries)
            chain.clear()

        for batch in passes(_flat(batches), "_text"):
            rows, names = batch.column("row"), ("key", "rid", "doc_id", "cps", "members")
            texts = batch.column("_text").to_pylist()
            for i, (k, rid, doc_id, cps, members) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                if k != key:
                    close()
                    key = k
                    if waiting > 8 << 20:
                        yield from flush()
                norm, mine = (texts[i] or b"").translate(None, SPACE), (cps, doc_id, rid)
                for one in chain:
                    if one[0] == norm:
                        one[2] += members
                        one[3].append(rid)
                        if _better(mine, one[1]):
                            one[1] = mine
                            one[4] = rows.take([i]) if kept_rows else None
                        break
                else:
                    chain.append([norm, mine, members, [rid], rows.take([i]) if kept_rows else None])
        close()
        yield from flush()

    def _flat(batches):
        for batch in batches:
            value = batch.column("row").field(text).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, "_text"])

    return own


def _owned(docs: DataFrame, text: str, doc_id: str, kept_rows: bool, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The index on shared files, and what the owner tasks make of its entries."""
    index = saved(docs.mapInArrow(_index(text, doc_id), _row_schema(docs)), "index")
    entries = index.where("members > 0")
    sizes = entries.groupBy(F.shiftrightunsigned("key", 64 - DEPTH).alias("p")).agg(F.sum("bytes").alias("b"))
    slots = directory({int(p): int(b) for p, b in sizes.collect()}, capacity)
    n, level = int(slots.max()) + 1, len(slots).bit_length() - 1
    slot = F.shiftrightunsigned("key", 64 - level) if level else F.lit(0)
    held = F.lit(bytearray(slots.astype(">u2").tobytes()))  # at most 128 KB, whatever the input
    bucket = F.conv(F.hex(F.substring(held, (slot * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("int")

    out = docs.schema if kept_rows else T.StructType(
        [T.StructField(c, t) for c, t in (("entry", T.LongType()), ("keep_id", T.LongType()), ("keep_rid", T.LongType()), ("group_size", T.LongType()), ("text_sha256", T.StringType()))]
    )
    arrow = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
    dealt = (
        entries.select("key", "rid", "doc_id", "cps", "members", "row", bucket.alias("bucket"))
        .repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("key", "rid")
        .select("key", "rid", "doc_id", "cps", "members", "row")
    )
    return index, dealt.mapInArrow(_owner(text, kept_rows, arrow), out)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, n_code_points.

    Texts are equal when identical without ASCII white space; null counts as empty, and empty texts are a group
    like any other. The row with the most code points, then the smallest doc_id (null last), then the first in
    the input stays, so exactly one of several repeated rows is kept. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index, classes = _owned(rows, "text", "doc_id", False, capacity)
    return (
        index.select("rid", "doc_id", "entry", F.col("cps").alias("n_code_points"))
        .join(classes, "entry")
        .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "n_code_points")
    )


def exact_distinct(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, under the rule of `exact_groups`."""
    return _owned(docs, text, doc_id, True, capacity)[1]
