"""Substring, exact and near duplicates and benchmark passages against brute force, on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ripplecart.llm import decontaminate, ngram_join, substring_dedup
from ripplecart.llm.common import BATCH_BYTES, mixed, small_batches, utf8
from ripplecart.llm.decontaminate import TestSet, Words, benchmark_matches, decontaminated, located_words
from ripplecart.llm.exact_dedup import directory, exact_distinct, exact_groups
from ripplecart.llm.ngram_join import PrefixTree, Signer, jaccard_components, one_of_each
from ripplecart.llm.substring_dedup import repeated_spans

#: Extra columns whose names the operators use inside.
CLASH = "row struct<a:int>, key long, h string, part int, doc string, label array<int>, kept boolean"
SCHEMA = f"doc_id long, text string, {CLASH}"
EXTRA = ({"a": 1}, 2, "h", 3, "d", [4], False)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def odd_texts(rng):
    """Families of near copies, exact copies, white-space variants, nulls, empties, repeated and very long rows."""
    words = ["Ab", "bé", "c", "dd", "ee,", "\x00f", "ñg"]
    rows = []
    for _ in range(14):
        base = [rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.choice([0, 1, 2, 4, 9, 30, 120]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                if copy:
                    copy[rng.randrange(len(copy))] = "z" + str(rng.randrange(9))
            rows.append(rng.choice([" ", "\n", " \t"]).join(copy))
    rows += [None, "", "", " \n\t", None, "long " * 30_000, "long " * 30_000 + "er", rows[0], rows[0]]
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [out[3], out[3], (None, rows[5]), (None, None), (7, "another text under a known id")]


# ------------------------------------------------------------------------------------------------- exact


def test_exact_groups_match_brute_force(spark):
    rows = odd_texts(random.Random(1))
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((doc_id, text))
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for doc_id, _ in members:
            want[doc_id, best[0], len(members), sha] += 1
    for capacity in (1 << 24, 500):
        got = exact_groups(table(spark, rows), capacity=capacity).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        left = exact_distinct(table(spark, rows), capacity=capacity)
        assert left.columns == table(spark, rows).columns
        kept = left.collect()
        assert Counter((r.doc_id, r.text) for r in kept) == Counter(min(m, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0)) for m in groups.values())
        assert all(r.row.a == 1 and r.label == [4] for r in kept)


def test_directory_doubles_where_it_is_full():
    slots = directory({0: 10, 1: 10, 5: 10, 7: 1}, capacity=15, depth=3)
    assert list(slots) == [0, 1, 2, 2, 3, 3, 3, 3]
    assert list(directory({}, 10, 4)) == [0]
    assert len(set(directory({9: 100}, 10, 4))) > 1  # one key can't be split further


def test_equal_hashes_of_different_texts_are_chained():
    import ripplecart.llm.exact_dedup as x

    rows = [(1, "a"), (2, "b"), (3, "a "), (4, "c"), (5, "b")]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 5), pa.array(range(5)), pa.array([r[0] for r in rows]), pa.array([len(r[1]) for r in rows]), pa.array([1] * 5),
                                        pa.array([{"text": r[1]} for r in rows])], names=["key", "rid", "doc_id", "cps", "members", "row"])
    schema = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
    made = [r for b in x._owner("text", False, schema)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["entry"], r["keep_id"], r["group_size"]) for r in made) == [(0, 3, 2), (1, 2, 2), (2, 3, 2), (3, 4, 1), (4, 2, 2)]


# ------------------------------------------------------------------------------------------------- substrings


def removed(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


@pytest.mark.parametrize(("hot", "collection"), [(1000, 1000), (1, 3)])
def test_repeated_spans_match_brute_force(spark, hot, collection):
    rng = random.Random(4)
    rows = [(i, t if t is None or len(t) < 9000 else "ab" * 50 + t[:3000]) for i, t in odd_texts(rng)]
    passage = "".join(rng.choice("abcd") for _ in range(45))
    rows += [(900 + i, f"é{rng.random()} {passage} {rng.random()}") for i in range(25)] + [(990, "x" * 400), (991, "xy" * 100)]
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (doc_id, _), raw, mask in zip(rows, texts, removed(texts, 40), strict=True):
        edge = np.diff(np.concatenate(([0], mask.astype(int), [0])))
        sha = hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~mask])).hexdigest()
        want[doc_id, len(raw), int(mask.sum()), int((edge == 1).sum()), sha] += 1
    got = repeated_spans(table(spark, rows), length=40, k=16, collection=collection, hot=hot)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_slices_leave_no_string_out():
    raw = [bytes(random.Random(5).choices(b"abc", k=700)), b"", b"short", b"abc" * 90]
    want = {(i, p, t[p : p + 40]) for i, t in enumerate(raw) for p in range(len(t) - 39)}
    got = set()
    for data, at, text, start in substring_dedup.slices(raw, 40, most=100):
        for n in range(len(at) - 1):
            piece = data[at[n] : at[n + 1]].tobytes()
            got |= {(int(text[n]), int(start[n]) + p, piece[p : p + 40]) for p in range(len(piece) - 39)}
        where, place, _, low, high = substring_dedup.anchors(data, at, 40, 16)
        assert ((high >= low) & (low >= 0) & (high <= 24)).all()
        assert int((high - low + 1).sum()) == int(np.maximum(np.diff(at) - 39, 0).sum())
    assert got == want


# ------------------------------------------------------------------------------------------------- near duplicates


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    name = {r: min((d for d in ids if d is not None), default=None) for r, ids in least.items()}
    return Counter((doc_id, len(sets[i]), name[root(i)]) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "block", "few"), [(3, 90, 512, 16), (3, 90, 2, 1), (5, 80, 512, 2), (5, 80, 3, 3), (2, 50, 2, 16)])
def test_components_match_brute_force(spark, n, num, block, few):
    rows = odd_texts(random.Random(6))
    got = jaccard_components(table(spark, rows), n, num, 100, block=block, few=few).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, num, 100)


def test_one_of_each_keeps_all_columns(spark):
    rows = [r for r in odd_texts(random.Random(7)) if r[0] not in (None, 7)]
    left = one_of_each(table(spark, rows), 5, 80, 100)
    assert left.columns == table(spark, rows).columns
    want = {d for d, _, c in brute_components(rows, 5, 80, 100) if d == c}
    assert {r.doc_id for r in left.collect()} == want


def brute_survivors(rows, n, num, den):
    """Per component of rows: the (doc_id, text) that may stay, by smallest id with null last; rows without words stay."""
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[label[i] if sets[i] else ("none", i)].append(row)
    return list(groups.values())


def test_one_of_each_decides_row_by_row(spark):
    a, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "ac")
    near = lambda t: t + " tail"
    rows = [(1, a), (2, near(a)), (2, c), (3, near(c))]  # the second row's namesake is another text
    assert sorted((r.doc_id, r.text) for r in one_of_each(table(spark, rows)).collect()) == [(1, a), (2, c)]
    rows = [(None, a), (None, near(a)), (None, near(a)), (5, c), (5, c), (5, near(c)), (None, ""), (None, None), (4, " "), (4, " ")]
    rows += [(9, t) for _, t in odd_texts(random.Random(10))[:25]] + [(None, t) for _, t in odd_texts(random.Random(11))[:25]]
    left = [(r.doc_id, r.text) for r in one_of_each(table(spark, rows), 5, 80, 100, block=3, few=2).collect()]
    groups = brute_survivors(rows, 5, 80, 100)
    assert len(left) == len(groups)
    rest = Counter(left)
    for group in groups:
        least = min((d for d, _ in group if d is not None), default=None)
        stays = [row for row in group if row[0] == least and rest[row]]
        assert stays, group
        rest[stays[0]] -= 1
    assert not +rest


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_any_base_are_told_apart(spark):
    one, other = thue_morse(10)
    rows = [(1, one), (2, other), (3, f"{one} {one} x"), (4, f"{other} {one} x")]
    got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    bench = spark.createDataFrame([(7, one)], "item_id long, text string")
    found = {r.doc.doc_id: list(r["items"]) for r in benchmark_matches(table(spark, rows), bench).collect()}
    assert found == {1: ["7"], 2: [], 3: ["7"], 4: ["7"]}


def test_ids_that_collide_are_settled_by_bytes(spark, monkeypatch):
    """A hash that knows a word by its length alone: only bytes tell words apart."""
    monkeypatch.setattr(decontaminate, "prime_hash", lambda data, starts, ends, seed=0: mixed((ends - starts).astype(np.uint64) + np.uint64(1000 * seed)))
    data, at = utf8(pa.array(["one two three four five six seven eight nine ten", "uno two three"]))
    w, text, data, starts, ends = located_words(data, at)
    assert not Words(w, data, starts, ends).sound
    keep = np.array([2, 3])  # "three" and "four"
    known = Words(w[keep], data, starts[keep], ends[keep])
    assert known.sound
    tests = TestSet([("i", w[keep])], 10, known)
    (where, _), = decontaminate._verified(tests, w, text, data, starts, ends)
    assert where.tolist() == [2]  # not "seven eight" or others of the same lengths


def test_null_and_repeated_ids_lose_no_span(spark):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdef ") for _ in range(400))
    texts = ["".join(rng.choice("ghijkl ") for _ in range(300)) for _ in range(6)]
    rows = [(None, texts[0] + passage), (None, passage + texts[1]), (8, texts[2] + passage), (8, texts[3]), (None, texts[4]), (None, None), (8, texts[5]), (8, texts[5])]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in repeated_spans(table(spark, rows)).collect())
    assert got == Counter([(None, 700, 400), (None, 700, 400), (8, 700, 400), (8, 300, 0), (None, 300, 0), (None, 0, 0), (8, 300, 300), (8, 300, 300)])


def test_linked_sets_share_a_signature_and_meet_in_the_tree():
    rng = random.Random(8)
    texts = [t for _, t in odd_texts(rng)]
    for n, num, den in ((3, 90, 100), (5, 80, 100), (2, 1, 3)):
        text, gram = ngram_join.ngrams(*utf8(pa.array(texts)), n)
        sizes, _ = ngram_join.set_hash(text, gram, len(texts))
        who, sig, needs = Signer(num, den).sign(text, gram, sizes)
        sets = [gram[text == i] for i in range(len(texts))]
        assert [len(s) for s in sets] == [len(shingles(t, n)) for t in texts]
        signed = [set(sig[who == i].tolist()) for i in range(len(texts))]
        some = [i for i in range(len(texts)) if len(sets[i])]
        want = {(a, b) for a, i in enumerate(some) for b, j in enumerate(some) if den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))}
        for a, b in want:
            i, j = some[a], some[b]
            shared = Counter(x & 255 for x in signed[i] & signed[j])
            both = [(k, max(needs[i, 1 + (k != needs[i, 0])], needs[j, 1 + (k != needs[j, 0])])) for k in shared]
            assert both and any(shared[k] >= least for k, least in both)
        got = {(s, q) for s, linked in PrefixTree([sets[i] for i in some]).join([sets[i] for i in some], num, den, width=3000) for q in linked.tolist()}
        assert got == want


# ------------------------------------------------------------------------------------------------- benchmark passages


def hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    mask, found, longest = [False] * len(words), set(), 0
    for item_id, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if size else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[s : s + size]:
                    mask[p : p + size] = [True] * size
                    found.add("" if item_id is None else str(item_id))
                    n = size
                    while p + n < len(words) and s + n < len(w) and words[p + n] == w[s + n]:
                        n += 1
                    longest = max(longest, n)
    return len(words), sum(mask), tuple(sorted(found)), longest


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_matches_against_brute_force(spark, block_bytes):
    rng = random.Random(9)
    pool = [f"W{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(pool, k=k))) for i, k in enumerate([12, 15, 3, 1, 0, 25, 10, 9])]
    items += [(None, "null item has words"), (100, None), (101, items[0][1]), (102, "Ünïcode ñ words a b c d e f g h i j")]
    rows = [(i, f"{' '.join(rng.choices(pool, k=rng.randrange(6)))}-{rng.choice(items)[1] or ''}.{' '.join(rng.choices(['q', 'r', 'W1'], k=rng.randrange(9)))}") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "null, ITEM has\nwords!"), (203, "x " * 5000 + items[5][1]), rows[0], (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_matches(table(spark, rows), bench, 10, block_bytes=block_bytes).collect()
    want = Counter((doc_id, *hits(text, items, 10)) for doc_id, text in rows)
    assert Counter((r.doc.doc_id, r.n_words, sum(b - a for a, b in r.spans), tuple(sorted(r["items"])), r.longest) for r in got) == want
    left = decontaminated(table(spark, rows), bench)
    assert left.columns == table(spark, rows).columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, t in rows if not hits(t, items, 10)[1])


def test_many_items_of_one_word_cost_a_pair_per_document(spark):
    items = [(i, "x") for i in range(1000)] + [(5000 + i, f"x y{i}") for i in range(3)]
    rows = [(1, "x " * 20_000), (2, "x y1"), (3, "z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc.doc_id: r for r in benchmark_matches(table(spark, rows), bench).collect()}
    assert sorted(got[1]["items"]) == sorted(str(i) for i in range(1000)) and got[1].longest == 1 and got[1].spans == [[0, 20_000]]
    assert len(got[2]["items"]) == 1001 and got[2].longest == 2 and not got[3]["items"]


def test_longest_match_goes_on_over_blocks_of_hits():
    rng = random.Random(13)
    passage = [f"w{rng.randrange(3)}" for _ in range(60)]
    texts = [" ".join(["q", *passage, "r"]), " ".join(passage[10:40]), " ".join(passage[:12] + ["q"] + passage[12:31])]
    items = [" ".join(passage), " ".join(passage[5:30]), " ".join(passage[5:30])]
    w, text, data, starts, ends = located_words(*utf8(pa.array(items)))
    cut = np.searchsorted(text, np.arange(4))
    tests = TestSet([(str(i), w[cut[i] : cut[i + 1]]) for i in range(3)], 10, Words(w, data, starts, ends))
    assert sorted(map(len, tests.ids)) == [1, 2]
    w, text, data, starts, ends = located_words(*utf8(pa.array(texts)))
    (where, window), = decontaminate._verified(tests, w, text, data, starts, ends)
    for most in (1, 7, 1 << 20):
        longest = np.zeros(3, np.int64)
        for d, n in tests.longest(0, where, window, text, most):
            np.maximum.at(longest, d, n)
        assert longest.tolist() == [hits(t, list(enumerate(items)), 10)[3] for t in texts]


# ------------------------------------------------------------------------------------------------- empty tables


def test_empty_tables(spark):
    none, bench = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert exact_groups(none).count() == exact_distinct(none).count() == repeated_spans(none).count() == 0
    assert jaccard_components(none).count() == one_of_each(none).count() == 0
    assert benchmark_matches(none, bench).count() == 0
    some = table(spark, [(1, "a b c"), (2, None)])
    assert {(r.doc.doc_id, len(r["items"])) for r in benchmark_matches(some, bench).collect()} == {(1, 0), (2, 0)}
    assert decontaminated(some, bench).count() == 2


def test_workers_get_bounded_batches(spark):
    """Before, a worker got up to 10,000 texts or sets at once, 34 MB of the check tool's documents, twice a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        texts = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat(id, ' word '), 800) AS text")
        assert jaccard_components(texts).count() == 3000
        sizes = texts.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert len(sizes) > 3 and max(r.n for r in sizes) < 2 * BATCH_BYTES
        spark.conf.set(key, str(1 << 20))
        small_batches(spark)
        assert int(spark.conf.get(key).removesuffix("b")) == 1 << 20  # a smaller setting stays
    finally:
        spark.conf.set(key, before)
