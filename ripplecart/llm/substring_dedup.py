"""Repeated byte strings across and within documents, by column-wise suffix sorting of aligned contexts.

**Why aligned contexts.** Building the Burrows-Wheeler transform of a whole collection column by column inserts one
symbol per document a round: as many passes over the transform as the longest document has bytes. Only strings of
`length` bytes matter here, so the collection is first cut where equal strings are cut alike. Each string of `length` bytes has
an anchor, the leftmost smallest hash among its k-grams. Equal strings have equal anchors at equal offsets. An anchor's
*context* is the union of the strings it anchors, `length` to about twice as many bytes. Contexts of one anchor hash
are aligned on it and form a small collection, built by the method: round by round, from the right, one
symbol is put in front of each context; the order of the round's suffixes follows from the previous order by a stable
sort on the new symbol (the transform's last-to-first step), the common prefixes from minima over the previous ones.
A string repeats exactly when the common prefix with a neighbour reaches `length`. Bytes are compared, hashes only
deal work out.

**Steps**, each one job whose result goes to sequential files in the shared folder: (1) scan: anchors as packed arrays, dealt
by hash; those at one place only are dropped. (2) The remaining places return to their texts, of equal texts to one, and
their contexts are written. (3) The collections are built, a hash range a task; repeated strings become byte
ranges. (4) Ranges are merged and cut out.

Texts with an exact copy of `length` bytes or more are repeated as a whole and take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import U64, mixed, powers, runs, saved, signed, tasks

#: Bytes of a pass, bits of a k-gram hash that order anchors (the rest hold the place in the pass).
PASS, PLACE_BITS = 2 << 20, 24
#: Contexts that one collection run holds.
COLLECTION = 40_000
#: Places of an anchor above which its contexts are cut into narrower ones before they are dealt out, and their width.
HOT, NARROW = 2_000, 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def slices(raw: list[bytes], length: int, most: int = PASS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passes over the texts: bytes, offsets of the pieces, the text of each piece and where in it the piece starts.

    A longer text is cut into pieces that overlap by length - 1 bytes, so that each string lies in exactly one.
    """
    pieces, held = [], 0
    for i, text in enumerate(raw):
        for start in range(0, max(len(text) - length + 1, 0), most):
            piece = text[start : start + most + length - 1]
            pieces.append((i, start, piece))
            held += len(piece)
            if held >= most:
                yield _pass(pieces)
                pieces, held = [], 0
    if pieces:
        yield _pass(pieces)


def _pass(pieces):
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    return data, np.cumsum([0] + [len(p[2]) for p in pieces]), np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])


def anchors(data: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Piece, place in it, hash, and the smallest and largest offset of its strings' starts before it, of each anchor."""
    window = length - k + 1
    n = len(data) - k + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    h = total[k:] - total[:-k]
    h *= down[:n]
    h = mixed(h)
    low = (h & ~U64((1 << PLACE_BITS) - 1)) | np.arange(n, dtype=U64)
    reach = 1
    while reach * 2 <= window:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < window:
        low = np.minimum(low[: len(low) - (window - reach)], low[window - reach :])
    place = (low & U64((1 << PLACE_BITS) - 1)).astype(np.int64)  # of the anchor of the string that starts here
    piece = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(place)]
    start = np.flatnonzero(np.arange(len(place)) + length <= at[piece + 1])
    place, piece = place[start], piece[start]
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), none, none
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1]), [True])))
    first, last = cut[:-1], cut[1:] - 1
    place = place[first]
    return piece[first], place - at[piece[first]], h[place], place - start[last], place - start[first]


_PAIR = np.dtype([("hash", "<u8"), ("text", "<u8"), ("place", "<u4"), ("low", "u1"), ("high", "u1")])
_SPOT = np.dtype([("hash", "<u8"), ("place", "<u4"), ("low", "u1"), ("high", "u1"), ("hot", "u1")])


def text_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw)


def _split(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _scan(length: int, k: int, parts: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            h = [text_hash(x) for x in raw]
            keys = np.array(h, U64)
            none = pa.nulls(len(raw), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.arange(len(raw)) % parts).astype(np.int32)), batch.column("doc_id").cast(pa.int64()), pa.array(signed(keys)),
                    pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), none,
                ],
                names=["part", "doc_id", "h", "n_bytes", "sha", "packed"],
            )
            first = {x: i for i, x in reversed(list(enumerate(h)))}  # equal texts of a batch once
            for data, at, text, start in slices([x if first[h[i]] == i else b"" for i, x in enumerate(raw)], length):
                piece, place, hashes, low, high = anchors(data, at, length, k)
                order, cut = _split((hashes >> U64(20)) % U64(parts), parts)
                pairs = np.empty(len(order), _PAIR)
                pairs["hash"], pairs["text"], pairs["place"] = hashes[order], keys[text[piece[order]]], place[order] + start[piece[order]]
                pairs["low"], pairs["high"] = low[order], high[order]
                held = [p for p in range(parts) if cut[p] < cut[p + 1]]
                blank = [pa.nulls(len(held), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *blank, pa.array([pairs[cut[p] : cut[p + 1]].tobytes() for p in held], pa.binary())], names=["part", "doc_id", "h", "n_bytes", "sha", "packed"])

    return scan


def _meet(hot: int):
    """Anchors of a part that occur at two places or more, packed by text hash. Document rows pass through."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            docs = batch.filter(batch.column("h").is_valid())
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in ("doc_id", "h", "n_bytes", "sha", "packed"))], names=["doc_id", "h", "n_bytes", "sha", "packed"])
            waiting += [np.frombuffer(x, _PAIR) for x in batch.column("packed").drop_null().to_pylist()]
        if not waiting:
            return
        pairs = np.concatenate(waiting)
        waiting.clear()
        order = np.lexsort((pairs["low"], pairs["place"], pairs["text"], pairs["hash"]))
        pairs = pairs[order]
        del order
        again = np.concatenate(([False], (pairs["hash"][1:] == pairs["hash"][:-1]) & (pairs["text"][1:] == pairs["text"][:-1]) & (pairs["place"][1:] == pairs["place"][:-1]) & (pairs["low"][1:] == pairs["low"][:-1])))
        pairs = pairs[~again]  # the copies of one text
        many = np.diff(runs(pairs["hash"]))
        many = np.repeat(many, many)
        pairs, many = pairs[many > 1], many[many > 1]
        order = np.argsort(pairs["text"], kind="stable")
        pairs = pairs[order]
        spots = np.empty(len(pairs), _SPOT)
        for c in ("hash", "place", "low", "high"):
            spots[c] = pairs[c]
        spots["hot"] = many[order] > hot
        cut = runs(pairs["text"])
        for start in range(0, len(cut) - 1, 10_000) if len(pairs) else ():
            ends = cut[start : start + 10_001]
            n = len(ends) - 1
            packed = [spots[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            h = np.ascontiguousarray(pairs["text"][ends[:-1]])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(signed(h)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(packed, pa.binary())], names=["doc_id", "h", "n_bytes", "sha", "packed"])

    return meet


def _contexts(length: int, k: int, parts: int):
    """Of texts with anchors that repeat: the text itself, and its contexts by part."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("h").to_pylist()
            kept = []
            out: dict[int, list[bytes]] = {}
            for raw, key, spots in zip(texts, keys, batch.column("spots").to_pylist(), strict=True):
                if raw is None or signed(np.array([text_hash(raw)], U64))[0] != key:
                    continue  # another text under a repeated id
                spot = np.frombuffer(b"".join(spots), _SPOT)
                known = spot["place"].astype(U64) << U64(32) ^ spot["hash"]
                hot = set(spot["hash"][spot["hot"] > 0].tolist())
                found = False
                for data, at, _, start in slices([raw], length):
                    _, place, hashes, low, high = anchors(data, at, length, k)
                    place = place + start[0]
                    repeats = np.isin(place.astype(U64) << U64(32) ^ hashes, known)
                    for p, h, lo, hi in zip(place[repeats].tolist(), hashes[repeats].tolist(), low[repeats].tolist(), high[repeats].tolist(), strict=True):
                        local = p - int(start[0])
                        first, last = local - hi, local - lo
                        for group, a, b in _narrowed(data, h, local, first, last, length) if h in hot else ((h, first, last),):
                            head = np.array([group, key & 0xFFFFFFFFFFFFFFFF], U64).tobytes() + np.array([p], "<u4").tobytes() + bytes([local - b, local - a])
                            body = data[a : b + length].tobytes()
                            out.setdefault((group >> 20) % parts, []).append(head + len(body).to_bytes(2, "little") + body)
                        found = True
                if found:
                    kept.append((key, raw))
            held = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(kept) + held, pa.int32()), pa.array([x[0] for x in kept] + [None] * len(held), pa.int64()), pa.array([x[1] for x in kept] + [b"".join(out[p]) for p in held], pa.binary())],
                names=["part", "h", "body"],
            )

    return contexts


def _narrowed(data: np.ndarray, h: int, anchor: int, first: int, last: int, length: int) -> Iterator[tuple[int, int, int]]:
    """The strings that start at first..last, cut by their offset to the anchor into runs of NARROW, each with a group of its own.

    All strings of a run share the bytes between the run's last possible start and the end of its first string; equal
    strings have equal offsets, hence the same run and the same shared bytes, whose hash names the group. A passage that very many
    texts share so meets itself only together with what stands beside it.
    """
    for run in range((anchor - last) // NARROW, (anchor - first) // NARROW + 1):
        a, b = max(first, anchor - run * NARROW - NARROW + 1), min(last, anchor - run * NARROW)
        core = data[anchor - run * NARROW : anchor - run * NARROW - NARROW + 1 + length].tobytes()
        yield xxhash.xxh3_64_intdigest(core, seed=(h + run) & 0xFFFFFFFF), a, b


_HEAD = 16 + 4 + 2 + 2


def _unpack(body: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    at = 0
    while at < len(body):
        h, key = np.frombuffer(body, U64, 2, at).tolist()
        place = int.from_bytes(body[at + 16 : at + 20], "little")
        low, high = body[at + 20], body[at + 21]
        n = int.from_bytes(body[at + 22 : at + 24], "little")
        yield h, key, place, low, high, body[at + _HEAD : at + _HEAD + n]
        at += _HEAD + n


class Collection:
    """Contexts of several anchors, aligned on them, sorted column by column from the right.

    `group` numbers the anchor hash of each context, `start` is the place of its first byte relative to the anchor (at most 0).
    Symbols of a context that has ended are numbered apart, so that an end matches nothing.
    """

    def __init__(self, group: np.ndarray, start: np.ndarray, texts: list[bytes], length: int):
        self.group, self.start, self.length = group, start, length
        self.first, self.end = int(start.min()), int((start + np.array([len(t) for t in texts])).max())
        wide = self.end - self.first
        self.symbol = np.full((wide, len(texts)), 256, np.uint16)  # in memory, a row per column of the contexts, one symbol per context
        for i, t in enumerate(texts):
            at = start[i] - self.first
            self.symbol[at : at + len(t), i] = np.frombuffer(t, np.uint8)

    def repeats(self) -> np.ndarray:
        """Columns x contexts: whether the string of `length` bytes that starts there stands in another context, too."""
        n = len(self.group)
        order = np.argsort(self.group, kind="stable")  # suffixes of the round, all empty at first
        group = self.group[order].astype(np.int64)
        common = np.zeros(n, np.int32)  # with the suffix before
        out = np.zeros(self.symbol.shape, bool)
        for column in range(len(self.symbol) - 1, -1, -1):
            symbol = self.symbol[column][order]
            key = group * 512 + symbol
            step = np.argsort(key, kind="stable")
            here = symbol[step]
            same = np.zeros(n, bool)
            same[1:] = (key[step][1:] == key[step][:-1]) & (here[1:] < 256)
            fresh = np.zeros(n, np.int32)
            if same.any():
                later, before = step[1:][same[1:]], step[:-1][same[1:]]
                beside = later == before + 1
                least = common[later].copy()
                far = np.flatnonzero(~beside)
                if len(far):
                    spans = np.stack([before[far] + 1, later[far] + 1], 1).ravel()
                    least[far] = np.minimum.reduceat(np.append(common, np.int32(0)), spans)[::2]
                fresh[1:][same[1:]] = least + 1
            order, common = order[step], fresh
            # neighbours of another anchor never share a symbol: their keys differ
            hit = common >= self.length
            if hit.any():
                both = hit.copy()
                both[:-1] |= hit[1:]
                out[column][order[both]] = True
        return out


_RANGE = ["h", "start", "end"]


def _sorted(length: int, most: int):
    """Byte ranges (h, start, end) of repeated strings, from the contexts of a part.

    A context that comes again repeats as a whole: its places are handed out at once, only the first waits.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[tuple[int, bytes], tuple[int, int] | None]] = {}
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            h, start, end = zip(*out, strict=True) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(np.array(h, U64))), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=_RANGE)

        for batch in batches:
            for body in batch.column("body").to_pylist():
                for h, key, place, _, high, text in _unpack(body):
                    group, mine = groups.setdefault(h, {}), (high, text)
                    if mine not in group:
                        group[mine] = key, place
                        continue
                    for at in (group[mine], (key, place)):
                        if at is not None:
                            out.append((at[0], at[1] - high, at[1] - high + len(text)))
                    group[mine] = None
                if len(out) > 50_000:
                    yield flush()
        waiting: list[list[tuple]] = []
        for group in groups.values():
            if len(group) > 1:
                waiting += _bounded([(high, text, at) for (high, text), at in group.items()], length, most)
            while sum(map(len, waiting)) >= most or len(waiting) > most:
                out += _built(waiting, length)
                waiting = []
                yield flush()
        out += _built(waiting, length)
        yield flush()

    return build


def _bounded(group: list[tuple], length: int, most: int, runs_of: int = NARROW) -> list[list[tuple]]:
    """A group, or the groups that it falls into when its strings are told apart by what all strings of a run of offsets share."""
    if len(group) <= most or runs_of < 1:
        return [group]
    parts: dict[tuple[int, bytes], list[tuple]] = {}
    for high, text, at in group:
        for run in range((high - (len(text) - length)) // runs_of, high // runs_of + 1):
            a, b = max(0, high - run * runs_of - runs_of + 1), min(len(text) - length, high - run * runs_of)
            core = text[high - run * runs_of : high - run * runs_of - runs_of + 1 + length]
            parts.setdefault((run, core), []).append((high - a, text[a : b + length], at))
    return [x for p in parts.values() if len(p) > 1 for x in (_bounded(p, length, most, runs_of // 4) if runs_of > 1 else [p])]


def _built(groups: list[list[tuple]], length: int) -> list[tuple[int, int, int]]:
    """Ranges of the strings that repeat among the distinct contexts (offset of the first string, bytes, place) of each group."""
    member = [(g, high, text, at) for g, group in enumerate(groups) for high, text, at in group]
    if not member:
        return []
    c = Collection(np.array([m[0] for m in member]), np.array([-m[1] for m in member]), [m[2] for m in member], length)
    repeated, out = c.repeats(), []
    for i, (_, high, text, at) in enumerate(member):
        if at is None:
            continue
        hit = repeated[-high - c.first : -high - c.first + len(text) - length + 1, i]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
        key, place = at
        out += [(key, place - high + a, place - high + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return out


_DONE = "h long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for h, raw, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("h", "body", "starts", "ends")), strict=True):
            spans: list[list[int]] = []
            for a, b in sorted(zip(starts, ends, strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            sha, at = hashlib.sha256(), 0
            for a, b in spans:
                sha.update(raw[at:a])
                at = b
            sha.update(raw[at:])
            out.append((h, sum(b - a for a, b in spans), len(spans), sha.hexdigest(), spans))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["h", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, length: int = 200, k: int = 100, collection: int = COLLECTION, hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte is removed when a string of `length` bytes that covers it also starts anywhere else in the column, in the same
    document or another; overlapping occurrences count. spans are the maximal removed byte ranges [start, end), kept_sha256
    is of the remaining bytes. A null text counts as empty; texts shorter than `length` lose nothing. Rows that repeat
    a text, whole repeated rows included, are copies of each other. doc_id is carried as it is. Other columns are not read.
    An empty table gives an empty result.
    """
    if not 8 <= k <= length or length - k > 255:
        raise ValueError("8 <= k <= length <= k + 255")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    parts = tasks(rows, 2)
    scanned = rows.mapInArrow(_scan(length, k, parts), "part int, doc_id long, h long, n_bytes long, sha string, packed binary")
    met = saved(scanned.repartitionById(parts, F.col("part")).mapInArrow(_meet(hot), "doc_id long, h long, n_bytes long, sha string, packed binary"), "met")
    known = met.where("packed is null").drop("packed")
    spots = met.where("packed is not null").groupBy("h").agg(F.collect_list("packed").alias("spots"))  # of one text
    texts = known.groupBy("h", "sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    wanted = spots.join(texts, "h").select("h", F.col("doc_id").alias("d"), F.col("sha").alias("s"), "spots")
    own = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)  # a text is found by its bytes, whatever its id
    met_texts = rows.withColumn("sha", own).join(wanted, (F.col("sha") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("h", "text", "spots")
    parted = saved(met_texts.mapInArrow(_contexts(length, k, parts), "part int, h long, body binary"), "contexts")
    ranges = parted.where("part is not null").select("part", "body").repartitionById(parts, F.col("part")).select("body").mapInArrow(_sorted(length, collection), "h long, start long, end long")
    ranges = saved(ranges, "ranges").groupBy("h").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))  # of one text
    bodies = parted.where("part is null").select("h", "body").dropDuplicates(["h"])
    done = saved(bodies.join(ranges, "h").mapInArrow(_cut_out, _DONE), "done")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<array<bigint>>")
    joined = known.join(texts.select("h", "sha", "copies"), ["h", "sha"]).join(done, "h", "left")
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
