"""Alignment of two tokenizers over the same bytes by sparse incidence matrices.

Each token sequence tiles the bytes of its text, so it is a token-byte incidence matrix in CSR form: a row per token, a
column per byte. A row-by-row (Gustavson) product of the one matrix with the transpose of the other has an entry for
every pair of tokens that share bytes, the number of shared bytes its value: the overlap links. Offsets where tokens
of both sides end cut the bytes into groups; the token-group incidence matrices give each group's tokens as rows of their
transposes, and their product's row sums count the shared-group links, which are kept in this factored form and
never listed pair by pair. A pass of texts is one matrix, block-diagonal by document.

How often two ids are linked in the whole corpus needs a second round. Passes are gathered into blocks of about `BLOCK`
text bytes; a document keeps its links as codes into the dictionary of its block's distinct id pairs. Only the dictionaries
are shuffled: summed by pair, ranked within the second id, and sent back to their blocks, where documents look
their codes up. So no text is encoded twice and no (document, pair) row is ever shuffled to the pair.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import counted, passes, runs, saved

#: Text bytes whose id pairs share a dictionary.
BLOCK = 8 << 20
#: Dictionary entries in one row.
CHUNK = 1 << 16

SCANNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, groups string, "
    "links array<struct<a: int, b: int, bytes: int>>, codes binary, times binary, first long, keys array<long>, ns array<long>"
)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, n_best long, count_sum long, groups_sha256 string"
DETAIL = ", groups string, links array<struct<a: int, b: int, bytes: int>>"


@dataclass(frozen=True)
class Csr:
    """Rows of a sparse matrix: the columns (ascending) and values of row i lie at indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")  # columns of tilings ascend already, which costs one pass
        indptr = np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=self.width))))
        row = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        return Csr(indptr, row[order], self.values[order], len(self.indptr) - 1)

    def __matmul__(self, other: Csr) -> Csr:
        """Gustavson's product: row i is the sum of the rows of `other` at the columns of row i, weighted by the values."""
        sizes = np.diff(other.indptr)[self.indices]
        at = np.repeat(other.indptr[self.indices], sizes) + counted(sizes)
        row = np.repeat(np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr)), sizes)
        key = row * other.width + other.indices[at]
        value = np.repeat(self.values, sizes) * other.values[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        start = runs(key)
        key, value = key[start[:-1]], np.add.reduceat(value, start[:-1]) if len(key) else value
        row = key // max(other.width, 1)
        return Csr(np.searchsorted(row, np.arange(len(self.indptr))), key - row * other.width, value, other.width)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Incidence of tokens that tile their bytes."""
    indptr = np.concatenate(([0], np.cumsum(lengths)))
    n = int(indptr[-1])
    return Csr(indptr, np.arange(n), np.ones(n, np.int32), n)


def token_groups(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Incidence of tokens and the groups that end at `cuts`; each token lies in one."""
    n = len(ends)
    return Csr(np.arange(n + 1), np.searchsorted(cuts, ends), np.ones(n, np.int64), len(cuts))


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of every id, end to end from start[id], and the decimal form of the ids in fixed width."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    digits: np.ndarray

    @staticmethod
    def of(pieces: list[bytes]) -> Vocabulary:
        size = np.array([len(p) for p in pieces], np.int64)
        wide = len(str(len(pieces)))
        digits = np.array([b"%d" % i for i in range(len(pieces))], f"S{wide}").view(np.uint8).reshape(-1, wide)
        return Vocabulary(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])), size, digits)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids], size) + counted(size)]


def byte_pairs(ranks: str):
    """Encoder and token bytes of a byte-level vocabulary in ranks form; strings of special tokens are plain text."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    pieces = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        pieces[rank] = piece
    return lambda texts: [np.array(coder.encode_ordinary(" " + t), np.int64) for t in texts], Vocabulary.of(pieces)


def pieces_of(model: str):
    """Encoder and token bytes of a piece model, which puts the space before the text itself."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [(coder.id_to_piece(i), coder.is_byte(i)) for i in range(coder.get_piece_size())]
    table = Vocabulary.of([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in names])
    return lambda texts: [np.array(ids, np.int64) for ids in coder.encode(texts, num_threads=1)], table


def _faithful(texts: list[bytes], ids: list[np.ndarray], vocabulary: Vocabulary) -> np.ndarray:
    """Whether the joined bytes of the tokens are the text."""
    return np.array([vocabulary.size[i].sum() == len(t) and vocabulary.decoded(i).tobytes() == t for t, i in zip(texts, ids, strict=True)], bool)


@dataclass(frozen=True)
class Aligned:
    """What a pass of texts gives, per text but for the links: rows of A, columns and shared bytes."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_shared: np.ndarray
    groups: list[bytes]
    a: np.ndarray
    b: np.ndarray
    shared: np.ndarray
    doc: np.ndarray


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_table: Vocabulary, b_table: Vocabulary) -> Aligned:
    """Links and groups of texts whose token bytes agree on both sides; a and b are positions within the pass."""
    n_a, n_b = (np.array([len(i) for i in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (a_ids, b_ids))
    left, right = token_bytes(a_table.size[a]), token_bytes(b_table.size[b])
    links = left @ right.transposed()

    cuts = np.intersect1d(left.indptr[1:], right.indptr[1:], assume_unique=True)
    in_a, in_b = token_groups(left.indptr[1:], cuts), token_groups(right.indptr[1:], cuts)
    rows_a, rows_b = in_a.transposed(), in_b.transposed()
    size_b = np.diff(rows_b.indptr)
    per_token = in_a @ Csr(np.arange(len(cuts) + 1), np.zeros(len(cuts), np.int64), size_b, 1)  # row sums of the product
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    bounds = np.concatenate(([0], np.searchsorted(cuts, left.indptr[end_a], "right")))
    total = np.concatenate(([0], np.cumsum(per_token.values)))

    # the groups as text: a token stands after the tokens of earlier groups, A before B
    at_a = np.arange(len(a)) + rows_b.indptr[in_a.indices]
    at_b = np.arange(len(b)) + rows_a.indptr[in_b.indices + 1]
    wide = max(a_table.digits.shape[1], b_table.digits.shape[1])
    text = np.zeros((len(a) + len(b), 1 + wide), np.uint8)
    text[at_a, 1 : 1 + a_table.digits.shape[1]] = a_table.digits[a]
    text[at_b, 1 : 1 + b_table.digits.shape[1]] = b_table.digits[b]
    text[:, 0] = ord(",")
    text[at_a[rows_a.indptr[:-1]], 0] = ord(";")
    text[at_b[rows_b.indptr[:-1]], 0] = ord("|")
    text[(end_a - n_a + end_b - n_b)[n_a > 0], 0] = 0
    used = text != 0
    ends = np.concatenate(([0], np.cumsum(used.sum(1))))
    flat = text[used].tobytes()
    stop = ends[end_a + end_b]
    groups = [flat[s:e] for s, e in zip(np.concatenate(([0], stop))[:-1], stop, strict=True)]
    row = np.repeat(np.arange(len(a)), np.diff(links.indptr))
    return Aligned(
        n_a, n_b, np.diff(bounds), total[end_a] - total[end_a - n_a], groups, row, links.indices, links.values, np.searchsorted(end_a, row, "right")
    )


def _scan(a_path: str | None, b_path: str | None, block_bytes: int, detail: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode_a, a_table = byte_pairs(a_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        encode_b, b_table = pieces_of(b_path or public_tokenizers.path("piece_bpe_32k.model"))
        wide = len(b_table.size)
        bits = (len(a_table.size) * wide).bit_length()
        block = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []  # rows of the block, with the distinct keys of each document and how often
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, block
            keys = np.concatenate([w[-2] for w in waiting])
            times = np.concatenate([w[-1] for w in waiting])
            distinct = np.unique(keys)
            codes = np.searchsorted(distinct, keys).astype("<u4")
            ns = np.bincount(codes, weights=times, minlength=len(distinct)).astype(np.int64)
            ends = np.cumsum([len(w[-2]) for w in waiting])
            parts = list(zip(*[w[:-2] for w in waiting], strict=True))
            n = len(waiting)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))]
            columns = [pa.array([block] * n, pa.int64()), *[pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]]
            cut = lambda x: [x[e - len(w[-2]) : e].tobytes() for w, e in zip(waiting, ends, strict=True)]
            columns += [pa.array(cut(codes), pa.binary()), pa.array(cut(times.astype("<u4")), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.list_(pa.int64()))] * 2], names=names)
            for first in range(0, len(distinct), CHUNK):
                chunk = [[distinct[first : first + CHUNK]], [ns[first : first + CHUNK]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), *[pa.nulls(1, k) for k in kinds], *[pa.nulls(1, pa.binary())] * 2, pa.array([first], pa.int64())]
                    + [pa.array(c, pa.list_(pa.int64())) for c in chunk],
                    names=names,
                )
            waiting, held, block = [], 0, block + 1

        names = [c.strip().split(" ")[0] for c in SCANNED.replace("struct<a: int, b: int, bytes: int>", "x").split(",")]
        for batch in passes(batches):
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            there = [i for i, t in enumerate(texts) if t]
            raw = [b" " + texts[i].encode() for i in there]
            a_ids, b_ids = encode_a([texts[i] for i in there]), encode_b([texts[i] for i in there])
            good = _faithful(raw, a_ids, a_table) & _faithful(raw, b_ids, b_table)
            there, a_ids, b_ids = ([x for x, g in zip(xs, good, strict=True) if g] for xs in (there, a_ids, b_ids))
            found = align(a_ids, b_ids, a_table, b_table)
            a, b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (a_ids, b_ids))
            keys = np.sort((found.doc << bits) | (a[found.a] * wide + b[found.b]))
            start = runs(keys)
            times, keys = np.diff(start), keys[start[:-1]]
            doc, keys = keys >> bits, keys & ((1 << bits) - 1)
            place = dict(zip(there, range(len(there)), strict=True))
            bounds = np.searchsorted(doc, np.arange(len(there) + 1))
            reach = np.searchsorted(found.doc, np.arange(len(there) + 1))
            first_a, first_b = np.cumsum(found.n_a) - found.n_a, np.cumsum(found.n_b) - found.n_b
            for i, doc_id in enumerate(doc_ids):
                if (k := place.get(i)) is None:
                    waiting.append((doc_id, 0, 0, 0, 0, 0, "", "" if detail else None, [] if detail else None, keys[:0], times[:0]))
                    continue
                lo, hi = reach[k], reach[k + 1]
                links = None
                if detail:
                    links = [dict(zip(("a", "b", "bytes"), x, strict=True)) for x in zip((found.a[lo:hi] - first_a[k]).tolist(), (found.b[lo:hi] - first_b[k]).tolist(), found.shared[lo:hi].tolist(), strict=True)]
                row = (doc_id, int(found.n_a[k]), int(found.n_b[k]), int(found.n_groups[k]), int(hi - lo), int(found.n_shared[k]))
                text = found.groups[k]
                waiting.append((*row, hashlib.sha256(text).hexdigest(), text.decode() if detail else None, links, keys[bounds[k] : bounds[k + 1]], times[bounds[k] : bounds[k + 1]]))
            held += sum(map(len, raw)) + 100 * len(doc_ids)
            if held >= block_bytes:
                yield from close()
        if waiting:
            yield from close()

    return scan


def _counted(detail: bool):
    """Documents of a block look their codes up among the corpus counts of the block's id pairs."""

    def look_up(docs: pa.Table, answers: pa.Table) -> pa.Table:
        count, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), bool)
        code = answers.column("code").to_numpy()
        count[code], best[code] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
        n_best, total = [], []
        for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist(), strict=True):
            codes, times = np.frombuffer(codes, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(times[best[codes]].sum()))
            total.append(int((times * count[codes]).sum()))
        made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        names = [c.split(" ")[0] for c in COUNTED.split(", ")] + (["groups", "links"] if detail else [])
        return pa.table({n: made[n] if n in made else docs.column(n) for n in names})

    return look_up


@dataclass(frozen=True)
class Alignment:
    """`docs`: a row per document; `pairs`: a row per linked id pair with its corpus count `n` and whether no other a has more with b."""

    docs: DataFrame
    pairs: DataFrame


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, block_bytes: int = BLOCK, detail: bool = False) -> Alignment:
    """Align the byte-level ids (A, of space + text) with the piece ids (B, of the text) of every document.

    docs: doc_id, n_a, n_b, n_groups, n_links, n_shared (shared-group links), n_best, count_sum, groups_sha256, and with
    `detail` the groups as text (`a1,a2|b1;a3|b2`) and the links (positions a and b, shared bytes). `a_path` is the ranks form of
    the byte-level vocabulary (the ids of its .json form, tested), `b_path` a piece model; both are read by the tasks.

    Null and empty texts, and texts that the joined bytes of either side do not give back, have no tokens: zeros, an empty digest,
    no groups and no links. Long texts are encoded whole and are a block by themselves. Repeated rows and null or
    repeated ids are documents like others, and all count. Other columns are not read, whatever their names. An empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scanned = saved(rows.mapInArrow(_scan(a_path, b_path, block_bytes, detail), SCANNED), "scanned")
    entries = scanned.where("keys is not null").select("block", "first", F.posexplode(F.arrays_zip("keys", "ns")).alias("i", "e"))
    entries = entries.select("block", (F.col("first") + F.col("i")).alias("code"), F.col("e.keys").alias("key"), F.col("e.ns").alias("n"))
    width = _width(b_path)
    pairs = saved(entries.groupBy("key").agg(F.sum("n").alias("n")).withColumn("b", F.col("key") % width), "pairs")
    most = F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("most")))  # a row per id of B at most
    ranked = pairs.join(most, "b").select("key", F.floor(F.col("key") / width).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = entries.select("block", "code", "key").join(ranked.select("key", "n", "best"), "key").select(F.col("block").alias("of"), F.col("code").alias("code"), "n", "best")
    kept = scanned.where("keys is null").drop("first", "keys", "ns", *([] if detail else ["groups", "links"]))
    out = kept.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_counted(detail), COUNTED + (DETAIL if detail else ""))
    return Alignment(out, ranked.drop("key"))


def _width(b_path: str | None) -> int:
    """Ids of the piece model, read from its file on the driver."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()
