"""Secret ledger, Merkle manifest and token alignment against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplecart.llm import merkle, secret_scan, token_alignment
from ripplecart.llm.common import scratch, table
from ripplecart.llm.merkle import folded, leaf_digest, manifest, regenerate, with_folded
from ripplecart.llm.queries import op12_merkle_manifest
from ripplecart.llm.secret_scan import RULES, Rule, joined, read_ledger, scan_versions
from ripplecart.llm.token_alignment import Csr, aligned

#: Extra columns whose names the operators use inside.
CLASH = "blob string, spans int, version long, block long, key string, path string, tree string, pos long, leaf string, n long, salt int"
EXTRA = ("b", 1, 2, 3, "k", "p", "t", 4, "l", 5, 6)


# ------------------------------------------------------------------------------------------------- secrets

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def secrets_of(text):
    found = [
        (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
        for rank, (kind, pattern, group, least) in enumerate(PATTERNS)
        for m in pattern.finditer(text or "") if len(m.group(group)) >= least
    ]
    return ",".join(x[2] for x in sorted(found))


def secret_texts():
    key, digest = "AKIA" + "Z9" * 8, "0123456789abcdef" * 2
    texts = [
        None, "", " ", "nothing here", f"password = {digest}", f"é😀ñ PassWord:'{key}'", f"token=short token==longer-one/x", "token=api_key\"=abcdefghijk",
        "secret = pass token = longvalue1 SECRET:\"x\" api-key=abcdefghi apikey: abcdefghi api_key=abcdefghi", f"AKIA {key} xAKIA{'A' * 11} AKIA{'B' * 12}",
        f"{digest}{digest}g{digest[:31]}G{digest[:32]}", "passwd=" * 5 + "12345678", f"ſecret=abcdefghij toKen=abcdefghij", "token=" + "a" * 50_000, f"password={digest}\npassword={digest}",
        "secret=12345678 " * 3000, f"{digest} " * 2000, "password  =  'abcdefgh", "password=\n12345678", f"token:{key}{digest}",
    ]
    rng = random.Random(1)
    parts = ["password", "TOKEN", "=", ":", " ", "'", '"', "abc", "1234", "AKIA", "ABCD0123", digest[:16], "_", "ü"]
    return texts + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(150)]


def test_spans_match_brute_force(spark):
    rows = [(i, t, *EXTRA) for i, t in enumerate(secret_texts())]
    rows += [rows[4], rows[4], (None, rows[5][1], *EXTRA), (7, rows[8][1], *EXTRA), (None, None, *EXTRA)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(3)
    got = scan_versions(docs).select("version.doc_id", "blob", joined(F.col("spans")).alias("s")).collect()
    assert Counter((r.doc_id, r.blob, r.s) for r in got) == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), secrets_of(r[1])) for r in rows)
    assert sum(bool(r.s) for r in got) > 30


def test_ledger_scans_each_blob_once_for_each_rule_version(spark):
    path = scratch(spark, "ledger")
    one, two = "password=abcdefgh1", "AKIA" + "A1" * 8
    versions = spark.createDataFrame([("a", 1, one), ("a", 2, two), ("b", 1, one), ("c", 1, None)], "path string, version int, text string")
    run = lambda v, rules: {(r.path, r.no): r.s for r in scan_versions(v, rules, path, carry=["path", "version"]).select(F.col("version.path"), F.col("version.version").alias("no"), joined(F.col("spans")).alias("s")).collect()}
    scanned = lambda: Counter(tuple(sorted(r.scanned)) for r in read_ledger(spark, path).collect())
    assert read_ledger(spark, path) is None
    first = run(versions, RULES)
    assert first == {("a", 1): "assign:0:18", ("a", 2): "access:0:20", ("b", 1): "assign:0:18", ("c", 1): ""}
    names = tuple(sorted(r.name for r in RULES))
    assert scanned() == {names: 3}  # three blobs, though four versions
    assert run(versions, RULES) == first and scanned() == {names: 3}  # nothing unseen
    more = versions.unionByName(spark.createDataFrame([("d", 1, two), ("d", 2, "f" * 40)], versions.schema))
    assert run(more, RULES) == first | {("d", 1): "access:0:20", ("d", 2): "hex:0:40"} and scanned() == {names: 4}
    newer = [Rule("assign", 2, "password", 0, 1), *RULES[1:]]  # one rule changes: it alone scans the blobs again
    assert run(more, newer)["a", 1] == "assign:0:8" and scanned() == {names: 4, ("assign@2",): 4}
    assert run(more, RULES)["a", 1] == "assign:0:18" and scanned() == {names: 4, ("assign@2",): 4}  # the old findings are kept
    found = Counter(r.rule for r in read_ledger(spark, path).select(F.inline("spans")).collect())
    assert found == {"assign@1": 1, "assign@2": 1, "access@1": 1, "hex@1": 1}


def test_scan_stays_in_the_jvm_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = scan_versions(docs)
    assert out.count() == 0
    plans = out._jdf.queryExecution().toString()
    assert "Python" not in plans and "MapInArrow" not in plans
    assert scan_versions(spark.createDataFrame([(1, None)], docs.schema), rules=[]).first().spans == []


# ------------------------------------------------------------------------------------------------- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(nodes, fan):
    """Root, and per node its path as [(place in the run, siblings)]."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at):
            run = nodes[k - k % fan : k - k % fan + fan]
            path.append((k % fan, "".join(run[: k % fan] + run[k % fan + 1 :])))
        at = [k // fan for k in at]
        nodes = [digest(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def plain_manifest(rows, fan=8):
    """Rows (doc_id, source, lang, n_chars, text) -> leaf, subroot, root, path."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(((r[0] is not None, r[0] or 0), digest(*map(value, r)), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in order:
        trees[lang].sort(key=lambda x: x[:2])
        subs[lang] = plain_tree([x[1] for x in trees[lang]], fan)
    root, above = plain_tree([subs[lang][0] for lang in order], fan)
    out = []
    for lang, up in zip(order, above):
        out += [(x[2][0], x[1], subs[lang][0], root, tuple(path + up)) for x, path in zip(trees[lang], subs[lang][1])]
    return out


def manifest_rows(n):
    rng = random.Random(n)
    rows = [(i * 7 % 1009, rng.choice(["s1", None, ""]), rng.choices([None, "", "de", "en", "éa", "Z"], [1, 1, 1, n / 3 + 1, 1, 1])[0], rng.choice([None, 3]), rng.choice([None, "", "Ab c", "ünï 😀" * 9])) for i in range(n)]
    return rows + ([rows[0], rows[0], (None, None, "en", None, None), (None, "s", "en", 1, "x"), (5, "y", "en", 1, "long " * 40_000)] if n else [])


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize(("n", "fan", "every"), [(0, 8, 2), (1, 8, 2), (40, 8, 2), (150, 2, 2), (150, 3, 1), (700, 8, 2), (300, 2, 3)])
def test_proofs_match_brute_force(spark, n, fan, every):
    rows = manifest_rows(n)
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{SCHEMA}, {CLASH}").repartition(3)
    made = manifest(docs, COLUMNS, fan=fan, every=every)
    proofs = made.proofs()
    assert [f.name for f in proofs.schema.fields] == ["key", "leaf", "subroot", "root", "path"]
    got = proofs.withColumn("back", folded(F.col("leaf"), F.col("path"))).collect()
    want = plain_manifest(rows, fan) if rows else []
    assert Counter((r.key, r.leaf, r.subroot, r.root, tuple((x.at, x.siblings) for x in r.path)) for r in got) == Counter(want)
    assert all(r.back == r.root for r in got)
    # only every `every`-th level is stored, a subtree a row
    widths = [row.n for layer in made.lower for row in layer.selectExpr("size(nodes) AS n").collect()]
    assert all(w <= fan**every for w in widths)
    if rows:
        most = max(Counter(r[2] for r in rows).values())
        assert len(made.lower) == max(1, next(d for d in range(1, 40) if most <= fan ** (every * d)))
        assert [r.digest for r in made.root.collect()] == [want[0][3]]
    else:
        assert made.root.count() == 0


def test_a_changed_value_is_found_and_nulls_differ_from_empty_texts(spark):
    rows = [(i, "s", "en", None, t) for i, t in enumerate(["Abc", "abc", None, "", "X" * 9])]
    docs = spark.createDataFrame(rows, SCHEMA)
    altered = leaf_digest(*[F.lower(c) if c == "text" else F.col(c) for c in COLUMNS])
    proofs = with_folded(manifest(docs, COLUMNS, carry={"altered": altered}).proofs(), F.col("altered")).collect()
    assert {r.key: r.verified for r in proofs} == {0: False, 1: True, 2: True, 3: True, 4: False}
    assert len({r.leaf for r in proofs}) == 5 and len({r.root for r in proofs}) == 1
    nulls = spark.createDataFrame([(1, None), (2, "")], "k int, v string").select(leaf_digest(F.col("v")).alias("d")).collect()
    assert nulls[0].d == digest("-") and nulls[1].d == digest("0:")


def test_regenerated_levels():
    nodes = [digest(str(i)) for i in range(20)]
    levels = regenerate(nodes, 2)
    assert [len(x) for x in levels] == [20, 3, 1] and levels[1][2] == digest(*nodes[16:])
    assert regenerate(nodes[:1], 2)[1:] == [[digest(nodes[0])], [digest(digest(nodes[0]))]]  # an only child is hashed, too


def test_manifest_query_tampers_a_third(spark):
    folder = "/root/testdata/sf0.001"
    rows = table(spark, folder, "documents").select(*COLUMNS).collect()
    want = {r[0]: r for r in plain_manifest([tuple(r) for r in rows])}
    upper = {r.doc_id: bool(re.search("[A-Z]", r.text or "")) for r in rows}
    got = op12_merkle_manifest(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.leaf, r.subroot, r.root) == want[r.doc_id][1:4]
        assert r.proof_sha256 == digest(*(s for _, s in want[r.doc_id][4]))
        assert r.verified == (r.folded_root == r.root) == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or not upper[r.doc_id])


# ------------------------------------------------------------------------------------------------- alignment


def test_csr_products_and_transposes_equal_dense_ones():
    rng = np.random.default_rng(2)
    for shape in ((5, 7, 4), (1, 1, 1), (0, 3, 2), (6, 0, 3)):
        a, b = (rng.integers(0, 3, (m, k)) * (rng.random((m, k)) < 0.5) for m, k in (shape[:2], shape[1:]))
        sparse = [Csr(np.concatenate(([0], np.cumsum((x != 0).sum(1)))).astype(int), np.nonzero(x)[1], x[x != 0], x.shape[1]) for x in (a, b)]

        def dense(m, rows):
            out = np.zeros((rows, m.width), int)
            for i in range(rows):
                out[i, m.indices[m.indptr[i] : m.indptr[i + 1]]] += m.values[m.indptr[i] : m.indptr[i + 1]]
            return out

        assert (dense(sparse[0] @ sparse[1], shape[0]) == a @ b).all()
        assert (dense(sparse[0].transposed(), shape[1]) == a.T).all()


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    a = lambda t: [(i, bytes(byte[c] for c in one.id_to_token(i))) for i in one.encode(" " + t, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    return a, lambda t: [(i, piece(i)) for i in two.encode(t)]


def brute_alignment(texts, tokenizers):
    """Per text: ids, groups as text, links (a, b, bytes); None without tokens."""
    out = []
    for text in texts:
        sides = [f(text) for f in tokenizers] if text else [[], []]
        if not text or any(b"".join(b for _, b in s) != b" " + text.encode() for s in sides):
            out.append(None)
            continue
        spans = []
        for side in sides:
            ends = np.cumsum([len(b) for _, b in side]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links = [(i, j, min(e, f) - max(s, t)) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[side[k][0] for k, (s, e) in enumerate(sp) if c0 < e <= c1] for side, sp in zip(sides, spans)] for c0, c1 in zip([0, *cuts[:-1]], cuts)]
        out.append((*[[i for i, _ in s] for s in sides], groups, links))
    return out


def alignment_texts(spark):
    rows = [r.text[:400] for r in table(spark, "/root/testdata/sf0.001", "documents").where("text is not null").limit(12).collect()]
    return [
        None, "", " ", "  two  spaces ", "a", "The quick brown fox", "<|endoftext|> and <s> are text </s>", "tab\tand\nline\r\n", "café \U0001f600 中文",
        "has ▁ inside", "\x00zero\x01", "x" * 700, "antidisestablishmentarianism " * 3, *rows, rows[0], rows[0],
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_alignment_matches_brute_force(spark, tokenizers, block_bytes):
    texts = alignment_texts(spark)
    ids = [*range(len(texts) - 2), None, 3]
    docs = spark.createDataFrame([(i, t, *EXTRA) for i, t in zip(ids, texts)], f"doc_id long, text string, {CLASH}").repartition(3)
    made = aligned(docs, block_bytes=block_bytes, detail=True)
    found = brute_alignment(texts, tokenizers)
    count = Counter((f[0][i], f[1][j]) for f in found if f for i, j, _ in f[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = Counter()
    for i, f in zip(ids, found):
        if f is None:
            want[i, 0, 0, 0, 0, 0, 0, 0, "", "", ()] += 1
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        pairs = [(a[x], b[y]) for x, y, _ in links]
        shared = sum(len(x) * len(y) for x, y in groups)
        best = sum(count[p] == most[p[1]] for p in pairs)
        want[i, len(a), len(b), len(groups), len(links), shared, best, sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest(), text, tuple(links)] += 1
    got = made.docs.collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_shared, r.n_best, r.count_sum, r.groups_sha256, r.groups, tuple((x.a, x.b, x.bytes) for x in r.links)) for r in got) == want
    assert sum(f is None for f in found) < 8 and len(got) == len(texts)
    pairs = {(r.a, r.b): (r.n, r.best) for r in made.pairs.collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in count.items()}


def test_alignment_of_long_texts_and_empty_tables(spark, tokenizers):
    assert aligned(spark.createDataFrame([], "doc_id long, text string")).docs.count() == 0
    text = "Words, words; words! " * 20_000
    row = aligned(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), block_bytes=1000).docs.where("doc_id = 1").first()
    a, b = (f(text) for f in tokenizers)
    assert (row.n_a, row.n_b) == (len(a), len(b)) and row.n_links >= max(row.n_a, row.n_b) and row.n_best <= row.n_links


def test_unfaithful_bytes_have_no_tokens():
    table = token_alignment.Vocabulary.of([b" a", b"b", b"x"])
    good = token_alignment._faithful([b" ab", b" ax", b" a"], [np.array([0, 1]), np.array([0, 1]), np.array([0, 1])], table)
    assert good.tolist() == [True, False, False]
    assert table.decoded(np.array([0, 2])).tobytes() == b" ax"
    assert secret_scan.SALTS > 1 and merkle.FAN == 8
