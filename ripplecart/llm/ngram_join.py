"""Exact n-gram Jaccard self-join and its components, by prefix-tree joins of blocks of sets.

**Dealing out.** Two sets whose similarity reaches num/den differ in at most D = (a + b)(den - num)/(den + num) n-grams.
Sets of a size class are cut by a hash of their n-grams into more groups than they may differ in, so linked
sets agree on whole groups: a group's hash is a *signature* that both have. Sets near a class border sign for the next class
as well. There are spare groups, so linked sets share at least a known number of signatures of non-empty groups; empty
groups sign too where a set has more of them than there are spare ones. Signatures travel as packed arrays, not as rows.
Two sets that share enough get a candidate link. Signatures of more than FEW sets are not paired: sets that have so many of
them that these alone could be enough are linked to the smallest such set of each. The components of candidate links are
*families*, nearly always true near copies: a passage that many texts share gives a few signatures, not enough.

**Joining.** A task gets the sets of a family. It puts them, in one global order of n-grams (commonest in the
task first), into a prefix tree and sends all queries down together: sets with a common beginning share the overlap counted
so far, and a query leaves a subtree once the n-grams still to come can't reach the overlap that the sizes ask for. It
hands out links that connect what was not connected, never all pairs. A family above a block first joins each set with
its most frequent leader; then only sets outside the family's largest component meet the family, block by block.

N-grams and sets are known by 62-bit hashes modulo primes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import U64, counted, mixed, passes, prime_hash, runs, saved, signed, small_batches, tasks, utf8
from ripplecart.llm.components import components

#: Sets of a block.
BLOCK = 512
#: Sets of a signature up to which their pairs are listed.
FEW = 16
#: Sizes of a size class differ by this factor at most.
CLASS = 0.75

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def ngrams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all texts, sorted: text number and 64-bit hash."""
    data = np.insert(_LOWER[data], at[1:], 0x20)
    at = at + np.arange(len(at))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True]))))
    starts, ends = edge[::2], edge[1::2]
    word = prime_hash(data, starts, ends)
    text = np.searchsorted(at, starts, "right") - 1
    many = np.bincount(text, minlength=len(at) - 1)
    place = counted(many)
    take = np.maximum(np.minimum(many, n), 1)[text]  # words of the n-gram that starts here
    first = place + take <= many[text]
    word = np.concatenate((word, np.zeros(n, U64)))
    key, start = take[first].astype(U64), np.flatnonzero(first)
    for i in range(n):
        here = word[start + i]
        key = np.where(i < take[first], mixed(key * U64(0x9E3779B97F4A7C15) + here), key)
    text = text[first]
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, bool)
    return text[new], key[new]


@dataclass(frozen=True)
class Signer:
    """Size classes and signatures for links at a similarity of num/den or more."""

    num: int
    den: int

    def classes(self, largest: int) -> np.ndarray:
        """Largest size of each class, up to one that covers all partners of the largest set."""
        width, out = min(CLASS, self.num / self.den), [1]
        while out[-1] < largest * self.den // self.num + 1:
            out.append(max(out[-1] + 1, int(out[-1] / width)))
        return np.array(out)

    def groups(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups of a class with largest size `top`, and how many more they are than linked sets need."""
        differ = 2 * top * (self.den - self.num) // (self.den + self.num)
        spare = np.where(differ > 0, 1 + 3 * differ // 10, 0)
        return differ + 1 + spare, spare

    def sign(self, text: np.ndarray, gram: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of the sets: text number and signature, whose last byte is the size class.

        And for each set its class, and the least number of signatures that it shares with a linked set in that
        class and in the next (0 where it does not sign); of two sets, the larger number holds.
        """
        needs = np.zeros((len(sizes), 3), np.int64)
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, U64), needs
        tops = self.classes(int(sizes.max()))
        own = np.searchsorted(tops, sizes, "left")
        needs[:, 0] = own % 256
        start = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for step in (0, 1):
            who = np.flatnonzero((sizes > 0) & ((step == 0) | (sizes * self.den // self.num > tops[own])))
            if not len(who):
                continue
            kind = own[who] + step
            n, spare = self.groups(tops[kind])
            base = np.concatenate(([0], np.cumsum(n)))
            item = np.repeat(start[who], sizes[who]) + counted(sizes[who])
            line = np.repeat(np.arange(len(who)), sizes[who])
            h = mixed(gram[item] + U64(0x5851F42D4C957F2D))
            slot = base[line] + ((h >> U64(32)) * n[line].astype(U64) >> U64(32)).astype(np.int64)
            total = np.zeros(base[-1], U64)
            np.add.at(total, slot, mixed(gram[item]))
            full = np.bincount(slot, minlength=base[-1])
            owner = np.repeat(np.arange(len(who)), n)
            empty = np.bincount(owner, full == 0, len(who))
            used = (full > 0) | (empty > spare)[owner]
            needs[who, 1 + step] = np.maximum(1 + spare - empty, 1)
            place = (kind[owner].astype(U64) << U64(32)) + counted(n).astype(U64)
            sig = mixed(total + mixed(place)) & ~U64(255) | (kind[owner] % 256).astype(U64)
            out.append((who[owner][used], sig[used]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), needs


def set_hash(text: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of each text's set."""
    total = np.zeros(n, U64)
    np.add.at(total, text, mixed(gram ^ U64(0xA0761D6478BD642F)))
    sizes = np.bincount(text, minlength=n)
    return sizes, mixed(total + sizes.astype(U64))


_SCANNED = "part int, doc_id long, th long, n long, h long, class int, need int, need_next int, packed binary"


#: (signature, set) pairs that a task gathers before it packs them by part.
GATHERED = 1 << 19


def _scan(n: int, signer: Signer, parts: int):
    """Per document a row with size and hash of its set; per part the packed (signature, set) pairs of many passes."""
    names = ["part", "doc_id", "th", "n", "h", "class", "need", "need_next", "packed"]

    def packed(waiting: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(waiting) if waiting else np.zeros((0, 2), U64)
        waiting.clear()
        part = ((pairs[:, 0] >> U64(8)) % U64(parts)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
        pairs, cut = pairs[order], np.searchsorted(part[order], np.arange(parts + 1))
        held = np.flatnonzero(np.diff(cut))
        blank = [pa.nulls(len(held), t) for t in (pa.int64(),) * 4 + (pa.int32(),) * 3]
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *blank, pa.array([pairs[cut[p] : cut[p + 1]].tobytes() for p in held], pa.binary())], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in passes(batches):
            rows = batch.num_rows
            text, gram = ngrams(*utf8(batch.column("text")), n)
            sizes, h = set_hash(text, gram, rows)
            _, first = np.unique(h, return_index=True)  # equal sets of a pass sign once
            once = np.zeros(rows, bool)
            once[first] = True
            who, sig, needs = signer.sign(text, gram, sizes)
            who, sig = who[once[who]], sig[once[who]]
            waiting.append(np.stack([sig, h[who]], 1))
            docs = [pa.array((np.arange(rows) % parts).astype(np.int32)), batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(signed(h))]
            docs += [pa.array(c.astype(np.int32)) for c in needs.T] + [pa.nulls(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(docs, names=names)
            if sum(map(len, waiting)) >= GATHERED:
                yield packed(waiting)
        if waiting:
            yield packed(waiting)

    return scan


_MET = "kind int, doc_id long, th long, n long, h long, class int, need int, need_next int, other long, shared int"
_DOC, _PAIR, _MANY = 0, 1, 2


def _meet(few: int = FEW, most: int = 1 << 21):
    """Of a part: pairs of sets that share signatures of at most `few` sets, with their number and size class; the rows
    (set, signature) of other signatures; document rows as they are.

    Signatures found to have more sets leave memory, so a part never holds more than `few` sets of each.
    """
    types = {"kind": pa.int32(), "doc_id": pa.int64(), "th": pa.int64(), "n": pa.int64(), "h": pa.int64(), "class": pa.int32(), "need": pa.int32(), "need_next": pa.int32(), "other": pa.int64(), "shared": pa.int32()}

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)).cast(t) for c, t in types.items()], names=list(types))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, many = np.zeros((0, 2), U64), np.zeros(0, U64)
        waiting, held = [], 0

        def compact() -> pa.RecordBatch | None:
            """Sort what waits into what is kept; the rows of signatures with more than `few` sets."""
            nonlocal kept, many, waiting, held
            pairs = np.concatenate([kept, *waiting])
            waiting, held = [], 0
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            if len(pairs):
                pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))]
            size = np.diff(runs(pairs[:, 0]))
            out = np.repeat(size, size) > few
            if len(many):
                out |= many[np.minimum(np.searchsorted(many, pairs[:, 0]), len(many) - 1)] == pairs[:, 0]
            gone, kept = pairs[out], pairs[~out]
            many = np.union1d(many, gone[:, 0])
            if not len(gone):
                return None
            sig, h = (np.ascontiguousarray(gone[:, c]) for c in (0, 1))
            n = len(gone)
            return rows(n, kind=pa.array(np.full(n, _MANY)), h=pa.array(signed(h)), other=pa.array(signed(sig)), **{"class": pa.array((sig & U64(255)).astype(np.int32))})

        for batch in batches:
            docs = batch.filter(batch.column("h").is_valid())
            if docs.num_rows:
                yield rows(docs.num_rows, kind=pa.array(np.full(docs.num_rows, _DOC)), **{c: docs.column(c) for c in ("doc_id", "th", "n", "h", "class", "need", "need_next")})
            for packed in batch.column("packed").drop_null().to_pylist():
                waiting.append(np.frombuffer(packed, U64).reshape(-1, 2))
                held += len(waiting[-1])
                if held >= max(most, 2 * len(kept)) and (made := compact()) is not None:
                    yield made
        if (made := compact()) is not None:
            yield made
        pa.default_memory_pool().release_unused()  # workers live on and are reused
        cut = runs(kept[:, 0])
        found = []
        for m in range(2, few + 1):  # all pairs of the signatures with m sets
            start = cut[:-1][np.diff(cut) == m]
            i, j = np.triu_indices(m, 1)
            if len(start):
                one, two = (start[:, None] + i).ravel(), (start[:, None] + j).ravel()
                found.append(np.stack([kept[two, 1], kept[one, 1], kept[one, 0] & U64(255)], 1))
        kept = np.zeros((0, 2), U64)
        if not found:
            return
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]).any(1))))
        shared = np.diff(np.append(new, len(found)))
        for a in range(0, len(new), 100_000):
            some, k = new[a : a + 100_000], shared[a : a + 100_000]
            h, other, kind = (np.ascontiguousarray(found[some, c]) for c in range(3))
            yield rows(len(some), kind=pa.array(np.full(len(some), _PAIR)), h=pa.array(signed(h)), other=pa.array(signed(other)), shared=pa.array(k), **{"class": pa.array(kind.astype(np.int32))})

    return meet


def _hints(met: DataFrame) -> DataFrame:
    """Candidate links h, leader with the number of signatures they share: all linked pairs are joined by them, directly or by way
    of the sets that share a signature of many."""
    sets = met.where(F.col("kind") == _DOC).groupBy("h").agg(F.first("class").alias("own"), F.first("need").alias("need"), F.first("need_next").alias("need_next"))
    need = F.when(F.col("class") == F.col("own"), F.col("need")).otherwise(F.col("need_next"))
    pairs = met.where(F.col("kind") == _PAIR).groupBy("h", F.col("other").alias("leader"), "class").agg(F.sum("shared").alias("shared"))
    many = saved(met.where(F.col("kind") == _MANY).select("h", "class", F.col("other").alias("sig")).distinct(), "many")
    load = saved(many.groupBy("h", "class").agg(F.count(F.lit(1)).alias("load")).join(sets, "h").select("h", "class", "load", need.alias("need")), "load")
    for who, at in (("h", "a"), ("leader", "b")):
        side = sets.select(F.col("h").alias(who), *(F.col(c).alias(f"{at}_{c}") for c in ("own", "need", "need_next")))
        pairs = pairs.join(side, who).join(load.select(F.col("h").alias(who), "class", F.col("load").alias(f"{at}_load")), [who, "class"], "left")
    needs = [F.when(F.col("class") == F.col(f"{at}_own"), F.col(f"{at}_need")).otherwise(F.col(f"{at}_need_next")) for at in ("a", "b")]
    spared = F.least(F.coalesce("a_load", F.lit(0)), F.coalesce("b_load", F.lit(0)))
    enough = pairs.where(F.col("shared") >= F.greatest(*needs) - spared)
    hot = load.where("load >= need").select("h", "class")
    rows = many.join(hot, ["h", "class"], "left_semi")
    leaders = rows.groupBy("sig").agg(F.min("h").alias("leader"))
    stars = rows.join(leaders, "sig").where("h <> leader").groupBy("h", "leader").agg(F.count(F.lit(1)).alias("shared"))
    return enough.select("h", "leader", "shared").unionByName(stars).groupBy("h", "leader").agg(F.sum("shared").alias("shared"))


# ---------------------------------------------------------------------------------------------------------------- prefix tree


class Forest:
    """Union-find over a few labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class PrefixTree:
    """Distinct sets of n-grams in a path-compressed prefix tree, in arrays, parents before children."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        tokens, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, -n))] = np.arange(len(tokens))  # the commonest first, so that beginnings are shared
        self.tokens, self.rank, self.sizes = tokens, rank, sizes
        owner = np.repeat(np.arange(len(sets)), sizes)
        which = rank[which]
        order = np.lexsort((which, owner))
        start = np.concatenate(([0], np.cumsum(sizes)))
        lists = [which[order][a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
        self.order = sorted(range(len(sets)), key=lambda i: lists[i].astype(">u4").tobytes())
        lists = [lists[i] for i in self.order]
        self.nodes: list[tuple[int, np.ndarray, int, int, int]] = []  # parent, its n-grams, depth at its end, first and last leaf
        common = [_common(a, b) for a, b in zip(lists[:-1], lists[1:], strict=True)] + [-1]
        self._grow(lists, common)

    def _grow(self, lists: list[np.ndarray], common: list[int]) -> None:
        """Nodes from the common beginnings of neighbours: each (depth, leaves) range once."""
        ranges, stack = [], []  # (first leaf, last leaf, depth)
        for i, lcp in enumerate(common):
            stack.append((i, len(lists[i])))
            while stack and stack[-1][1] > lcp:
                first, depth = stack.pop()
                ranges.append((first, i, depth))
                if lcp >= 0 and (not stack or stack[-1][1] < lcp):
                    stack.append((first, lcp))
        ranges.sort(key=lambda r: (r[0], -r[1], r[2]))
        open_: list[tuple[int, int, int]] = []  # node number, last leaf, depth
        for first, last, depth in ranges:
            while open_ and open_[-1][1] < last:
                open_.pop()
            parent, above = (open_[-1][0], open_[-1][2]) if open_ else (-1, 0)
            self.nodes.append((parent, lists[first][above:depth], depth, first, last))
            open_.append((len(self.nodes) - 1, last, depth))

    def join(self, queries: list[np.ndarray], num: int, den: int, width: int = 32 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(set, queries linked to it), all pairs with num * union <= den * overlap, by blocks of queries."""
        step = max(1, width // max(1, len(self.tokens)))
        tops = [max(self.sizes[self.order[i]] for i in range(f, la + 1)) for _, _, _, f, la in self.nodes]
        lows = [min(self.sizes[self.order[i]] for i in range(f, la + 1)) for _, _, _, f, la in self.nodes]
        for begin in range(0, len(queries), step):
            some = queries[begin : begin + step]
            length = np.array([len(q) for q in some])
            has = np.zeros((len(self.tokens), len(some)), bool)  # n-gram by query
            for k, q in enumerate(some):
                at = np.minimum(np.searchsorted(self.tokens, q), len(self.tokens) - 1)
                has[self.rank[at[self.tokens[at] == q]], k] = True
            state: list[tuple[np.ndarray, np.ndarray]] = []
            everyone = np.arange(len(some)), np.zeros(len(some), np.int64)
            for v, (parent, grams, depth, first, last) in enumerate(self.nodes):
                alive, overlap = state[parent] if parent >= 0 else everyone
                if len(alive):
                    overlap = overlap + (has[grams] if len(alive) == len(some) else has[grams][:, alive]).sum(0)
                    x = length[alive]
                    # what is still to come can't exceed the rest of the longest set below, nor the query's size the shortest
                    keep = ((overlap + tops[v] - depth) * (num + den) >= num * (x + tops[v])) & (x * den >= num * lows[v])
                    alive, overlap = alive[keep], overlap[keep]
                state.append((alive, overlap))
                for leaf in range(first, last + 1) if len(alive) else ():
                    s = self.order[leaf]
                    if self.sizes[s] == depth:
                        linked = overlap * (num + den) >= num * (length[alive] + depth)
                        if linked.any():
                            yield s, begin + alive[linked]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


_TASK = "key string, role int, h long, label long, grams binary"


def _joined(num: int, den: int):
    """Tree joins of the tasks in a partition, which come one after the other: links between different labels.

    Role 0 rows are sets of the tree, role 1 rows queries; role 2 rows are both.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, {}, []

        def close() -> None:
            sets = [(h, label, g) for h, (role, label, g) in rows.items() if role != 1]
            queries = [(h, label, g) for h, (role, label, g) in rows.items() if role != 0]
            rows.clear()
            if not sets or not queries or (len(sets) == 1 and len(queries) == 1 and sets[0][0] == queries[0][0]):
                return
            forest = Forest()
            for s, linked in PrefixTree([x[2] for x in sets]).join([x[2] for x in queries], num, den):
                for q in linked.tolist():
                    if forest.join(sets[s][1], queries[q][1]):
                        out.append((queries[q][0], sets[s][0]))

        def flush() -> pa.RecordBatch:
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("key", "role", "h", "label", "grams"))
            for k, role, h, label, grams in zip(*cols, strict=True):
                if k != key:
                    close()
                    key = k
                    if len(out) > 50_000:
                        yield flush()
                old = rows.get(h)
                rows[h] = (role if old is None or old[0] == role else 2, label, np.frombuffer(grams, U64))
        close()
        if out:
            yield flush()
        pa.default_memory_pool().release_unused()

    return join


def _tree_join(rows: DataFrame, num: int, den: int) -> DataFrame:
    dealt = rows.select("key", "role", "h", "label", "grams").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_joined(num, den), "a long, b long")


def _with_text_hash(docs: DataFrame) -> DataFrame:
    """`th` tells texts apart that share a doc_id, or have none; two texts of one id that share it are one row."""
    return docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """h, n, grams of the wanted (h, doc_id, th): the texts are read again, only those asked for leave the join."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows may repeat: each set once a task
        for batch in passes(batches):
            rows = batch.num_rows
            text, gram = ngrams(*utf8(batch.column("text")), n)
            sizes, h = set_hash(text, gram, rows)
            cut = np.concatenate(([0], np.cumsum(sizes)))
            keep = signed(h) == np.array(batch.column("h"))
            for i, key in enumerate(h.tolist()):
                if keep[i] and key in done:
                    keep[i] = False
                elif keep[i]:
                    done.add(key)
            grams = [gram[a:b].tobytes() if k else b"" for a, b, k in zip(cut[:-1], cut[1:], keep, strict=True)]
            made = pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(sizes, pa.int64()), pa.array(grams, pa.binary())], names=["h", "n", "grams"])
            yield made.filter(pa.array(keep))

    asked = wanted.select("h", F.col("least.doc_id").alias("d"), F.col("least.th").alias("t"))
    texts = docs.join(asked, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("h", "text")
    return texts.mapInArrow(sets, "h long, n long, grams binary")


def links(docs: DataFrame, n: int, num: int, den: int, block: int = BLOCK, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """All documents as (doc_id, th, n, h), and links (a, b) between set hashes whose components are those of all links."""
    small_batches(docs.sparkSession)
    parts = 2 * tasks(docs)  # a part's signatures are sorted in one worker
    docs = _with_text_hash(docs.select("doc_id", "text"))
    scanned = docs.mapInArrow(_scan(n, Signer(num, den), parts), _SCANNED)
    met = saved(scanned.repartitionById(parts, F.col("part")).mapInArrow(_meet(few), _MET), "met")
    known = met.where(F.col("kind") == _DOC).select("doc_id", "th", "n", "h")
    hints = saved(_hints(met), "hints")
    family = saved(components(hints, "h", "leader").select(F.col("v").alias("h"), F.col("label").alias("family")), "family")
    holders = known.groupBy("h").agg(F.min(F.struct("doc_id", "th")).alias("least"))
    sets = saved(_sets_of(docs, family.join(holders, "h").select("h", "least"), n), "sets")
    members = sets.join(family, "h")
    counts = saved(family.groupBy("family").agg(F.count(F.lit(1)).alias("members")), "counts")
    small = members.join(counts.where(F.col("members") <= block), "family")
    found = saved(_tree_join(small.select(F.col("family").cast("string").alias("key"), F.lit(2).alias("role"), "h", F.col("h").alias("label"), "grams"), num, den), "links")
    if not counts.where(F.col("members") > block).head(1):
        return known, found
    large = saved(members.join(counts.where(F.col("members") > block), "family").select("family", "members", "h", "n", "grams"), "large")
    return known, found.unionByName(_large_links(large, hints, num, den, block))


def _large_links(large: DataFrame, hints: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links of families above a block."""
    # each set and the leader it shares most signatures with, dealt into chunks of a leader's sets
    best = hints.groupBy("h").agg(F.max_by("leader", F.struct("shared", "leader")).alias("leader"))
    led = large.join(best, "h").select("leader", "h", "grams", F.pmod(F.xxhash64("h"), F.ceil(F.col("members") / block)).alias("chunk"))
    chunks = led.groupBy("leader", "chunk").agg(F.count(F.lit(1)).alias("k")).select("leader", "chunk")
    leaders = chunks.join(large.select(F.col("h").alias("leader"), F.col("grams")), "leader")
    key = F.concat_ws(":", "leader", "chunk")
    star = led.select(key.alias("key"), F.lit(0).alias("role"), "h", F.col("h").alias("label"), "grams").unionByName(
        leaders.select(key.alias("key"), F.lit(1).alias("role"), F.col("leader").alias("h"), F.col("leader").alias("label"), "grams")
    )
    stars = saved(_tree_join(star, num, den), "stars")
    label = saved(components(stars, "a", "b").select(F.col("v").alias("h"), "label"), "labels")
    rows = large.join(label, "h", "left").select("family", "h", "n", "grams", F.coalesce("label", "h").alias("label"))
    rows = saved(rows, "labelled")
    main = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("family").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    # blocks of a family by size class, so that only sizes that can link meet
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num))) + F.lit(1e-9))
    rows = rows.join(main, "family").withColumn("size", size).withColumn("rest", F.col("label") != F.col("main"))
    load = rows.groupBy("family", "size").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("rest").cast("long")).alias("r"))
    blocks = F.ceil(F.col("k") / block)
    load = saved(load.select("family", "size", blocks.alias("sets"), F.ceil(F.col("r") / block).alias("queries")), "load")
    rows = rows.join(load, ["family", "size"])
    spot = F.pmod(F.xxhash64("h", F.lit("block")), F.when(F.col("role") == 1, F.greatest("queries", F.lit(1))).otherwise(F.col("sets")))
    near = load.select(F.col("family").alias("f2"), F.col("size").alias("other"), F.col("sets").alias("other_sets"), F.col("queries").alias("other_queries"))
    meets = (F.col("family") == F.col("f2")) & (F.abs(F.col("size") - F.col("other")) <= 1)
    asking = rows.where("rest").withColumn("role", F.lit(1)).withColumn("spot", spot)
    asking = asking.join(near, meets).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("other_sets") - 1)))
    asked = rows.withColumn("role", F.lit(0)).withColumn("spot", spot)
    asked = asked.join(near.where("other_queries > 0"), meets).withColumn("of", F.explode(F.sequence(F.lit(0), F.col("other_queries") - 1)))
    asking = asking.select(F.concat_ws(":", "family", "size", "spot", "other", "to").alias("key"), "role", "h", "label", "grams")
    asked = asked.select(F.concat_ws(":", "family", "other", "of", "size", "spot").alias("key"), "role", "h", "label", "grams")
    return stars.unionByName(saved(_tree_join(asking.unionByName(asked), num, den), "rest"))


def _classed(rows: DataFrame, n: int, num: int, den: int, block: int, few: int) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, th, n, h), and the sets that are linked or repeated: h, label of their component."""
    known, found = links(rows, n, num, den, block, few)
    label = components(found, "a", "b")
    sets = known.where("n > 0").groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    classed = sets.join(label.withColumnRenamed("v", "h"), "h", "left").where("label is not null or copies > 1")
    return known, saved(classed.select("h", F.coalesce("label", "h").alias("label")), "classes")


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    A document's set is its distinct n-word shingles, its whole word sequence where it has fewer words; documents link
    when den * overlap >= num * union. component_id is the smallest doc_id reachable by links, the document's own included.
    Null and empty texts, and those of white space alone, have an empty set and are linked with nothing. Very long texts give their
    whole set. Rows that repeat a doc_id count as documents of their own with the same id; a null doc_id is larger than all
    others, and a component of such rows alone has a null id. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    known, classed = _classed(rows, n, num, den, block, few)
    members = known.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("least")).join(classed, "h")
    least = members.groupBy("label").agg(F.min("least").alias("component"))
    joined = classed.join(least, "label").select("h", "component").withColumn("many", F.lit(True))
    out = known.join(joined, (known["h"] == joined["h"]) & (known["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("many"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """The rows of `docs`, all columns, with exactly one row of each component of linked documents: the smallest doc_id's.

    Rows are decided one by one: a repeated or null doc_id neither spares nor condemns its namesakes. A null doc_id comes after all
    others; of rows with the same id, the smallest text hash stays; of rows that repeat id and text, any one. Documents without
    words are linked with nothing and stay, repeated ones too. Very long texts give their whole set. Columns of any name are carried.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    known, classed = _classed(rows, n, num, den, block, few)
    mine = known.where("n > 0").join(classed, "h").groupBy("label", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    best = mine.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    decided = saved(mine.join(best, "label").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "rows", kept.alias("kept")), "decided")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = _with_text_hash(marked).drop("text")
    same = (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    stay = marked.join(decided.where("not kept or rows > 1"), same, "left_anti").select("doc.*")
    again = decided.where("kept and rows > 1")
    if again.isEmpty():
        return stay
    one = marked.join(again.select("_d", "_t"), same, "left_semi").dropDuplicates(["doc_id", "th"])
    return stay.unionByName(one.select("doc.*"))
