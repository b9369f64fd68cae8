"""Pack tokenised documents into full windows by Karmarkar-Karp multiway differencing.

Every task packs its own rows, so nothing is shuffled. Whole windows are cut from long documents; the rest of each
document (under one window) is an item. Groups of items are split into near-equal windows by differencing: a partial
partition is a vector of window loads; the two with the largest spread merge, the heaviest load of one
onto the lightest of the other. The general operator (`balanced_windows`) raises the window count whenever the
heaviest window exceeds the capacity.

Where documents may be cut freely (`pack_documents`), the differencing runs with as many windows as the tokens
fill, the heads above the capacity are cut off and fill the windows below it, so all windows are full. What is left
goes into the next group, and at the end of a task into windows whose lengths are powers of two, which are not padded.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import passes

#: Items that one differencing run takes.
GROUP = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items of each of k windows by multiway differencing; every item in exactly one window."""
    if k <= 1:
        return [list(range(len(sizes)))] if k == 1 else []
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[-1] = size
        heap.append((-size, i, loads, [[] for _ in range(k - 1)] + [[i]]))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        loads = a + b[::-1]
        order = np.argsort(loads, kind="stable")
        merged = [x + y for x, y in zip(at, reversed(bt), strict=True)]
        loads = loads[order]
        n += 1
        heapq.heappush(heap, (-int(loads[-1] - loads[0]), n, loads, [merged[j] for j in order]))
    return heap[0][3] if heap else [[] for _ in range(k)]


def balanced_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of whole items, none above `capacity`; each item must fit a window by itself.

    The count starts at the least possible and rises by one whenever a window exceeds the capacity. No items give no
    windows; items of size 0 go wherever differencing puts them.
    """
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity")
    k = max(-(-sum(sizes) // capacity), 1 if sizes else 0)
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


def full_windows(items: list[tuple[int, int, int]], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows of exactly `capacity` tokens, and the pieces left over (less than one window in all).

    An item is (document, start, length) and may be cut anywhere.
    """
    k = sum(x[2] for x in items) // capacity
    if not k:
        return [], items
    windows, spare = [], []
    for members in difference([x[2] for x in items], k):
        window, room = [], capacity
        for doc, start, length in sorted((items[i] for i in members), key=lambda x: -x[2]):
            if (fit := min(length, room)) > 0:
                window.append((doc, start, fit))
                room -= fit
            if length > fit:
                spare.append((doc, start + fit, length - fit))
        windows.append((window, room))
    for window, room in windows:
        while room:
            doc, start, length = spare.pop()
            window.append((doc, start, fit := min(length, room)))
            room -= fit
            if length > fit:
                spare.append((doc, start + fit, length - fit))
    return [w for w, _ in windows], spare


def powers_of_two(items: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows whose lengths are the powers of two that add up to the items' tokens; capacity is a power of two or more."""
    out, items, total = [], list(reversed(items)), sum(x[2] for x in items)
    while total:
        room = min(capacity, 1 << (total.bit_length() - 1))
        total -= room
        window = []
        while room:
            doc, start, length = items.pop()
            window.append((doc, start, fit := min(length, room)))
            room -= fit
            if length > fit:
                items.append((doc, start + fit, length - fit))
        out.append(window)
    return out


def byte_bpe(vocabulary: str):
    """Encoder of the byte-level vocabulary in ranks form, the special token's string included as that token.

    `vocabulary` is the path of the .tiktoken file beside the .json of the same vocabulary; both give the same ids
    (tested), the ranks form four times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: coder.encode(text, allowed_special="all")


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def _packed(capacity: int, vocabulary: str | None, end_id: int, group: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary or vocabulary_path())
        sequence = TaskContext.get().partitionId() << 40
        ids: dict[int, tuple[int | None, np.ndarray]] = {}  # of documents that still have pieces to place
        items: list[tuple[int, int, int]] = []
        out: list[tuple] = []
        n = 0

        def place(window) -> None:
            nonlocal sequence
            at = 0
            for doc, start, length in window:
                doc_id, tokens = ids[doc]
                out.append((doc_id, start, length, zlib.crc32(tokens[start : start + length].tobytes()), len(tokens), sequence, at))
                at += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in passes(batches):
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                tokens = np.array([*encode(text or ""), end_id], "<u4")
                ids[n] = doc_id, tokens
                whole = len(tokens) // capacity * capacity
                for start in range(0, whole, capacity):
                    place([(n, start, capacity)])
                if whole < len(tokens):
                    items.append((n, whole, len(tokens) - whole))
                else:
                    del ids[n]
                n += 1
                if len(items) >= group:
                    windows, items = full_windows(items, capacity)
                    for window in windows:
                        place(window)
                    ids = {d: ids[d] for d in {x[0] for x in items}}
            if out:
                yield flush()
        windows, items = full_windows(items, capacity)
        for window in [*windows, *powers_of_two(items, capacity)]:
            place(window)
        if out:
            yield flush()

    return pack


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of `docs` is encoded whole and closed by `end_id`; null counts as empty, so it gives one piece with the
    end id alone. Pieces of a sequence follow each other from offset 0. All sequences hold `capacity` tokens but the
    last few of a task, whose lengths are powers of two; `capacity` must be one. doc_id is carried as it is,
    null and repeated ones too; each row is a document of its own. Other columns are not read. An empty table gives
    no pieces.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_packed(capacity, vocabulary, end_id, group), PIECES)
