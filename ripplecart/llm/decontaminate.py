"""Benchmark passages in the corpus, by suffix arrays over the training shards.

Every run of documents in a task is a shard. Its suffix array holds the word positions, sorted by the words that follow,
of all suffixes that can match: those whose first words begin some test suffix (a bit table says so, without
misses). Every test suffix is binary-searched in it; the equal range gives all places, and matches that go
on along a diagonal give the longest verbatim match. The corpus is not shuffled.

The test set travels to the tasks in blocks of a fixed number of text bytes; a larger one means more passes of the same
shard through further blocks, not a larger block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplecart.llm.common import U64, counted, mixed, passes, prime_hash, runs, spans_hash, utf8

#: Text bytes of the benchmark in one block.
BLOCK_BYTES = 8 << 20
HEAD_BITS = 22

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, start and end of each word in them, and the text that it stands in."""
    if not len(data):
        return np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 3
    data = np.insert(_LOWER[data], at[1:], 0)  # a zero byte ends each text
    at = at + np.arange(len(at))
    inside = np.concatenate(([False], _WORD[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edge[::2], edge[1::2], np.searchsorted(at, edge[::2], "right") - 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words of all texts, and the text that each stands in; A-Z are lower-cased."""
    data, starts, ends, text = _split(data, at)
    return spans_hash(data, starts, ends) | U64(1), text


def located_words(data: np.ndarray, at: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Odd ids of the words of all texts, the text that each stands in, the lower-cased bytes, and each word's start and end in them."""
    data, starts, ends, text = _split(data, at)
    return prime_hash(data, starts, ends, seed) | U64(1), text, data, starts, ends


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[np.repeat(starts, sizes) + counted(sizes)]


class Words:
    """The words behind the ids of a test set, to compare bytes."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.ids, first = np.unique(ids, return_index=True)
        self.sizes = (ends - starts)[first]
        self.data = gathered(data, starts[first], self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: Whether no two words share an id.
        self.sound = bool(self.same(ids, data, starts, ends).all())

    def same(self, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each word, known by an id of the test set, has the bytes of the test set's word."""
        at, sizes = np.searchsorted(self.ids, ids), ends - starts
        out = self.sizes[at] == sizes
        at, starts, sizes, line = at[out], starts[out], sizes[out], np.flatnonzero(out)
        differ = gathered(data, starts, sizes) != gathered(self.data, self.starts[at], sizes)
        out[np.repeat(line, sizes)[differ]] = False
        return out


class TestSet:
    """Distinct windows of the items, as word ids in suffix order, and where they stand: in which item class, at which place.

    Items of the same words are one class.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, known: Words, seed: int = 0):
        self.window, self.known, self.seed = window, known, seed
        self.ids: list[list[str]] = []  # of each class
        self.groups = []  # (length, sorted window matrix, window -> pairs, pairs' class, pairs' place)
        classes: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for name, w in items:
            size = min(window, len(w))
            if not size:
                continue
            n = classes.setdefault(w.tobytes(), len(self.ids))
            if n < len(self.ids):
                self.ids[n].append(name)
                continue
            self.ids.append([name])
            for s in range(len(w) - size + 1):
                by_length.setdefault(size, []).append((w[s : s + size], n, s))
        for size, rows in sorted(by_length.items()):
            grid = np.array([r[0] for r in rows], U64).reshape(-1, size)
            order = np.lexsort(grid.T[::-1])
            grid = grid[order]
            new = np.concatenate(([True], (grid[1:] != grid[:-1]).any(1)))
            self.groups.append((size, grid[new], np.append(np.flatnonzero(new), len(grid)), np.array([rows[i][1] for i in order]), np.array([rows[i][2] for i in order])))
        self.head = min(4, min(by_length, default=1))
        self.bits = np.zeros(1 << HEAD_BITS, bool)
        for _, grid, *_ in self.groups:
            self.bits[heads(grid.T[: self.head])] = True

    def search(self, w: np.ndarray, text: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hits in a shard per group of windows: first words in ascending order, and the window that matches there."""
        if len(w) < self.head or not self.groups:
            return []
        first = np.flatnonzero(self.bits[heads([w[i : len(w) - self.head + 1 + i] for i in range(self.head)])])
        deepest = max(g[0] for g in self.groups)
        ahead = first[:, None] + np.arange(deepest)
        inside = ahead < len(w)
        ahead = np.minimum(ahead, len(w) - 1)
        suffix = np.where(inside & (text[ahead] == text[first][:, None]), w[ahead], U64(0))  # 0 ends a text and sorts first
        order = np.lexsort(suffix.T[::-1])
        first, suffix = first[order], suffix[order]  # the suffix array of the shard, to the depth of a window
        found = []
        for size, grid, *_ in self.groups:
            low, high = (binary_search(suffix[:, :size], grid, side) for side in ("left", "right"))
            many = high - low
            window = np.repeat(np.arange(len(grid)), many)
            where = first[np.repeat(low, many) + counted(many)]
            by_place = np.argsort(where, kind="stable")
            found.append((where[by_place], window[by_place]))
        return found

    def classes_of(self, group: int, doc: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, int]]:
        """Distinct (document, class) pairs of a group's hits: from the distinct windows of a document, not from its hits."""
        _, grid, pairs, item, _ = self.groups[group]
        key = np.unique(doc * len(grid) + window)
        doc, window = key // len(grid), key % len(grid)
        for at in range(0, len(key), 10_000):
            many = pairs[window[at : at + 10_000] + 1] - pairs[window[at : at + 10_000]]
            pair = np.repeat(pairs[window[at : at + 10_000]], many) + counted(many)
            both = np.unique(np.repeat(doc[at : at + 10_000], many) * len(self.ids) + item[pair])
            yield from zip((both // len(self.ids)).tolist(), (both % len(self.ids)).tolist(), strict=True)

    def longest(self, group: int, where: np.ndarray, window: np.ndarray, text: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts and the words of the matches that end in them, diagonal by diagonal, at most about `most` (hit, place) pairs at a time."""
        size, _, pairs, item, place = self.groups[group]
        many = pairs[window + 1] - pairs[window]
        total, start = np.cumsum(many), 0
        open_: dict[tuple[int, int], int] = {}  # class and next place -> matches on that diagonal so far, up to `last`
        last = (-2, -1)
        while start < len(where):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
            while end < len(where) and where[end] == where[end - 1]:
                end += 1
            n = many[start:end]
            pair = np.repeat(pairs[window[start:end]], n) + counted(n)
            at, c, p = np.repeat(where[start:end], n), item[pair], place[pair]
            order = np.lexsort((at, at - p, c))
            at, c, p = at[order], c[order], p[order]
            cut = runs(np.cumsum(np.concatenate(([0], (at[1:] != at[:-1] + 1) | (p[1:] != p[:-1] + 1) | (c[1:] != c[:-1]) | (text[at[1:]] != text[at[:-1]])))))
            head, tail, length = cut[:-1], cut[1:] - 1, np.diff(cut)
            if open_ and where[start] == last[0] + 1 and text[where[start]] == last[1]:
                for r in np.flatnonzero(at[head] == where[start]).tolist():
                    length[r] += open_.get((int(c[head[r]]), int(p[head[r]])), 0)
            yield text[at[tail]], size - 1 + length
            last = int(where[end - 1]), int(text[where[end - 1]])
            open_ = {(int(c[tail[r]]), int(p[tail[r]]) + 1): int(length[r]) for r in np.flatnonzero(at[tail] == last[0]).tolist()} if end < len(where) else {}
            start = end


def heads(columns) -> np.ndarray:
    key = np.zeros(len(columns[0]), U64)
    for c in columns:
        key = (key + c) * U64(0x9E3779B97F4A7C15)
    return (mixed(key) >> U64(64 - HEAD_BITS)).astype(np.int64)


def binary_search(rows: np.ndarray, wanted: np.ndarray, side: str) -> np.ndarray:
    """Place of each wanted row among the sorted ones, all searched at once."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(rows), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        a, b = rows[np.minimum(mid, max(len(rows) - 1, 0))], wanted
        differ = a != b
        at = differ.argmax(1)
        line = np.arange(len(wanted))
        less = np.where(differ.any(1), a[line, at] < b[line, at], side == "right")
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(pairs):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


_FOUND = [("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.int64())]


def _verified(tests: TestSet, w: np.ndarray, text: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hits whose words have the bytes of the test set's words."""
    while True:
        found = tests.search(w, text)
        inside = np.zeros(len(w) + 1, np.int64)
        for (size, *_), (where, _) in zip(tests.groups, found, strict=False):
            np.add.at(inside, where, 1)
            np.add.at(inside, where + size, -1)
        inside = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        wrong = inside[~tests.known.same(w[inside], data, starts[inside], ends[inside])]
        if not len(wrong):
            return found
        w = w.copy()
        w[wrong] = U64(2)  # ids are odd: another word


def _searched(block, last: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestSet = block.value
        for batch in passes(batches):
            n = batch.num_rows
            w, text, data, starts, ends = located_words(*utf8(batch.column("text")), tests.seed)
            n_words = np.bincount(text, minlength=n)
            before = np.concatenate(([0], np.cumsum(n_words)))
            found = _verified(tests, w, text, data, starts, ends)
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [[] for _ in range(n)]
            items = [set(x) for x in batch.column("items").to_pylist()] if "items" in batch.schema.names else [set() for _ in range(n)]
            longest = np.array(batch.column("longest")) if "longest" in batch.schema.names else np.zeros(n, np.int64)
            if any(len(where) for where, _ in found):
                edge = np.zeros(len(w) + 1, np.int64)
                for g, (where, window) in enumerate(found):
                    size = tests.groups[g][0]
                    np.add.at(edge, where, 1)
                    np.add.at(edge, where + size, -1)
                    for d, c in tests.classes_of(g, text[where], window):
                        items[d].update(tests.ids[c])
                    if size < tests.window:
                        np.maximum.at(longest := longest.copy(), text[where], size)  # all words of an item
                    else:
                        for d, length in tests.longest(g, where, window, text):
                            np.maximum.at(longest := longest.copy(), d, length)
                hit = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
                # a run of hits goes on within its text only: runs are cut where the text changes
                change = np.flatnonzero(hit[1:] != hit[:-1])
                touched = set()
                for s, e in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                    for d in range(int(text[s]), int(text[e - 1]) + 1):
                        a, b = max(s, int(before[d])), min(e, int(before[d + 1]))
                        if a < b:
                            spans[d].append([a - int(before[d]), b - int(before[d])])
                            touched.add(d)
                for d in touched:
                    spans[d] = [list(x) for x in merged([tuple(x) for x in spans[d]])]
            made = [pa.array(n_words, pa.int64()), pa.array(spans, _FOUND[1][1]), pa.array([sorted(x) for x in items], _FOUND[2][1]), pa.array(longest, pa.int64())]
            names = ["doc"] if last else ["doc", "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *(c for c, _ in _FOUND)])

    return search


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[TestSet]:
    """The benchmark's windows in blocks of about `block_bytes` of text; the driver holds one at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).toArrow()
        seed = 0
        while True:
            w, text, data, starts, ends = located_words(*utf8(part.column("text")), seed)
            known = Words(w, data, starts, ends)
            if known.sound:
                break
            seed += 1  # another base for a block in which two words share an id
        cut = np.searchsorted(text, np.arange(part.num_rows + 1))
        yield TestSet([(i, w[cut[k] : cut[k + 1]]) for k, i in enumerate(part.column("id").to_pylist())], window, known, seed)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc (a struct of the `carry` columns), n_words, spans, items, longest.

    Words are maximal runs of 0-9, a-z (after lower-casing A-Z) and characters beyond ASCII. A window is `window`
    consecutive words of an item, or all words of an item that has fewer; spans are the merged word ranges [start, end)
    that windows cover, items the ids (as strings, unsorted) of items with a window in the text, longest the words of the
    longest verbatim match. Words are found by hash and compared by bytes before they count. Null and empty texts have no words; items without words match nothing; a null item_id
    counts as the empty string and rows of one item_id as one item. Without benchmark rows nothing is hit. A very long text is
    searched whole, as a shard by itself; repeated rows and ids are searched row by row.
    """
    carry = docs.columns if carry is None else carry
    out = docs.select(F.struct(*carry).alias("doc"), F.col("text"))
    doc, found = out.schema["doc"], T.StructType.fromDDL("n_words long, spans array<array<long>>, items array<string>, longest long").fields
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks_of(benchmark, window, block_bytes)]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        kept = [doc] if last else [doc, T.StructField("text", T.StringType())]
        out = out.mapInArrow(_searched(block, last), T.StructType(kept + found))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs`, all columns, that no window of the benchmark occurs in."""
    return benchmark_matches(docs, benchmark, window).where(F.size("items") == 0).select("doc.*")
