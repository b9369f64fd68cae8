"""Row-wise operators: packing by round trip, URL rules and main text by examples and brute force, models by held-out accuracy."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ripplecart.llm import html_text, language_id, packing, quality, toxicity
from ripplecart.llm.common import remainder, table
from ripplecart.llm.html_text import main_text, main_texts
from ripplecart.llm.packing import balanced_windows, byte_bpe, difference, full_windows, pack_documents, powers_of_two, vocabulary_path
from ripplecart.llm.url_filter import Cascade, SegmentedCascade, rules_of, url_verdicts

FOLDER = "/root/testdata/sf0.01"
CLASH = "score double, lang_pred int, doc string, row int, token array<int>"


# ------------------------------------------------------------------------------------------------- packing


def test_differencing_covers_and_balances():
    rng = random.Random(1)
    for k, sizes in ((1, [3]), (3, [8, 7, 6, 5, 4]), (5, []), (20, [rng.randrange(2000) for _ in range(200)]), (4, [0, 0, 1])):
        windows = difference(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and len(windows) == k
        loads = [sum(sizes[i] for i in w) for w in windows]
        if len(sizes) == 200:
            assert max(loads) - min(loads) < 200
    assert difference([], 0) == [] == balanced_windows([], 10)


def test_window_count_rises_until_all_fit():
    sizes = [6, 6, 6, 2]
    windows = balanced_windows(sizes, 10)  # 20 tokens would fill two windows, but two sixes don't fit one
    assert len(windows) == 3 and all(sum(sizes[i] for i in w) <= 10 for w in windows)
    with pytest.raises(ValueError, match="capacity"):
        balanced_windows([11], 10)


def test_cut_windows_are_full_and_the_rest_are_powers_of_two():
    rng = random.Random(2)
    for _ in range(50):
        items = [(d, rng.randrange(5), rng.randrange(1, 64)) for d in range(rng.randrange(40))]
        windows, rest = full_windows(items, 64)
        assert all(sum(x[2] for x in w) == 64 for w in windows) and sum(x[2] for x in rest) < 64
        tail = powers_of_two(rest, 64)
        assert all((n := sum(x[2] for x in w)) & (n - 1) == 0 for w in tail)
        covered = defaultdict(list)
        for doc, start, length in (x for w in [*windows, *tail] for x in w):
            covered[doc] += range(start, start + length)
        assert {d: sorted(v) for d, v in covered.items()} == {d: list(range(s, s + n)) for d, s, n in items}


def test_pieces_round_trip(spark):
    from tokenizers import Tokenizer
    from public_tokenizers import path

    rng = random.Random(3)
    texts = ["", None, "one", "<|endoftext|> in text", "Ünï ñ 漢字 ​\x00", "word " * 9000, "a" * 5000, " \n\t " * 300, "x" * 2047]
    texts += [" ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [*enumerate(texts), (3, "again"), (None, "no id"), (2, "one")]
    docs = spark.createDataFrame([(*r, 1.0, 2, "d", 3, [4]) for r in rows], f"doc_id long, text string, {CLASH}").repartition(3)
    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {t: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts + ["again", "no id"]}
    pieces = pack_documents(docs, 2048, group=16).collect()
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(ids[text])
    total, filled = Counter(), defaultdict(list)
    for p in pieces:
        assert any(len(w) == p.doc_tokens and zlib.crc32(w[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for w in want[p.doc_id])
        total[p.doc_id] += p.length
        filled[p.sequence_id].append((p.offset, p.length))
    assert total == Counter({d: sum(map(len, w)) for d, w in want.items()})
    short = 0
    for at in filled.values():
        at.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(at[:-1], at[1:], strict=True)) and at[0][0] == 0
        size = at[-1][0] + at[-1][1]
        assert size == 2048 or (size < 2048 and size & (size - 1) == 0)
        short += size < 2048
    assert short <= 11 * 3
    assert pack_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        pack_documents(docs, 1000)


def test_ranks_give_the_ids_of_the_tokenizer(spark):
    from tokenizers import Tokenizer
    from public_tokenizers import path

    coder, fast = Tokenizer.from_file(path("byte_bpe_50k.json")), byte_bpe(vocabulary_path())
    texts = [r.text or "" for r in table(spark, FOLDER, "documents").select("text").collect()]
    assert [x.ids for x in coder.encode_batch(texts, add_special_tokens=False)] == [fast(t) for t in texts]


# ------------------------------------------------------------------------------------------------- URL rules


def brute_verdict(url, rules, default="allow"):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None, default
    end = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min((i for i, c in enumerate(rest) if c in "?#"), default=len(rest))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("most_bytes", [1 << 22, 0])
def test_url_verdicts_match_brute_force(spark, most_bytes):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b", ""), ("allow", "a.b", "/xy"), ("block", "", "/root")]
    hosts = ["x.net", "NET", "example.net", "www.Example.NET", "notnet", "example.com", "my.example.com", "badexample.com", "org", "q.org", "a.b", "c.a.b", "", "a..b", "ÄB.org", "net.", "example.net:80", "x\ty.net", "x\nnet"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/1?x=/en/", "?q=/en/", "#/", "/xyz", "/root/a", "/EN/", "//", "/de/#f?", "/\n/en/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "HTTPS://") for h in hosts for p in paths] + [None, "", "no scheme.net/", "://net/", "mailto:a@net", "http://x.net/?u=http://example.com/de/"] * 2
    clash = "page_id long, url string, key string, rule int, _best string, _url long, row string, _host int, segment long"
    pages = spark.createDataFrame([(i, u, "x", 1, "b", 2, "r", 3, 4) for i, u in enumerate(urls)], clash).repartition(3)
    judged = url_verdicts(pages, rules_of(spark, rules), most_bytes=most_bytes)
    assert judged.columns == ["page_id", "url", "key", "rule", "_best", "_url", "row", "segment", "_host", "_path", "_rule", "_verdict"]
    rows = judged.collect()
    assert {r.page_id: (r._host, r._path, r._rule, r._verdict) for r in rows} == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert len(rows) == len(urls) and all((r._best, r._url, r.row, r.segment) == ("b", 2, "r", 4) for r in rows)
    assert url_verdicts(pages.limit(0), rules_of(spark, rules), most_bytes=most_bytes).count() == 0
    assert {r._verdict for r in url_verdicts(pages, spark.createDataFrame([], "verdict string, host string, path string"), default="block").collect()} == {"block"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(40_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = spark.range(0, 40_000, 7).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).unionByName(spark.createDataFrame([("never seen",), (None,)], "key string"))
    cascade = Cascade.of(listed, universe)
    assert len(cascade.levels) >= 2  # false positives are there to be taken back
    got = universe.withColumn("in", cascade.has(F.col("key")))
    assert got.where(F.col("in") != (F.substring("key", 2, 9).cast("int") % 7 == 0)).count() == 0
    assert got.where("in").count() == len(range(0, 40_000, 7))


def test_segments_are_exact_and_bounded(spark):
    universe = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = spark.range(0, 30_000, 7).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).unionByName(spark.createDataFrame([("never seen",), (None,)], "key string"))
    cascade = SegmentedCascade.of(listed, universe, words=16)
    assert cascade.segments > 40 and len(cascade.levels) >= 2 and cascade.table.count() == cascade.segments
    assert cascade.table.select(F.max(F.size("words0"))).first()[0] <= 17
    got = cascade.marked(universe.unionByName(spark.createDataFrame([(None,)], "key string")), "in")
    assert got.columns == ["key", "in"]
    assert got.where("key is not null").where(F.col("in") != (F.substring("key", 2, 9).cast("int") % 7 == 0)).count() == 0
    assert got.where("in and key is not null").count() == len(range(0, 30_000, 7))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


# ------------------------------------------------------------------------------------------------- main text

LONG = "This paragraph has a good many words, and commas, and even a second sentence. Here it is; it ends now."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<!-- only a comment", ""),
        ("<script>var t='<p>x</p>';</script><style>p{}</style>", ""),
        (f"<nav>menu</nav><p>{LONG}</p>", LONG),
        ("<html><body><article><h1>Title</h1><p>x</p></article><div class='ad'>" + LONG * 5 + "</div></body></html>", "Title x"),
        (f"<body><header>Site</header><main><h1>T</h1><p><b>Bo</b>ld<br>line</p><ul><li>one<li>two</ul><p>{LONG}</p><form><input>Send</form></main><aside>{LONG}</aside><footer>{LONG}</footer></body>", f"T Bold line one two {LONG}"),
        (f"<div id=header>Site, name</div><div id='page'><div class='post-content'><h2>T &amp; U&nbsp;V</h2><p>{LONG}<p>a  &lt;b&gt;\n c</div><div class='comments'><p>{LONG}</p></div></div><div class=sidebar>{LONG}</div>", f"T & U V {LONG} a <b> c"),
        (f"<div class='cookie-notice'>{LONG}</div><div><p>{LONG}</p><p>short</p></div><div role=navigation><a>x</a></div><p hidden>{LONG}</p><div style='display: none'>{LONG}</div>", f"{LONG} short"),
        (f"<article><p>{LONG}</p><section class='related'><p>{LONG}</p></section><table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG} a b c"),
        ("<article>x<script>document.write('</p>')</script>y<textarea><p>z</textarea></article>", "x y"),
        ("<article><p>one</i></b> two</p></div></article></article><p>", "one two"),
        ("<article>a<![CDATA[<b>]]>c &#x41;&#66;&eacute; &unknown; &amp;amp;</article>", "a<b>c ABé &unknown; &amp;"),
        ("1 < 2 and <3> so", "1 < 2 and <3> so"),
        ("<article>it <a href=it's title = 'a > b' data-x=\"<p>\">is</a> so<p", "it is so"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


ARTICLE = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"


@pytest.mark.parametrize("attrs", ["class='overflow-hidden'", "class='layout has-sidebar'", "class='post no-comments'", "id='page' class='page with-footer'", "data-hidden='false'", "data-id='ad'", "title='x class=ad'", "class='md:hidden'", "class='sidebar'", "class='page comments'", "id=menu"])
def test_wrapper_of_the_text_is_read_whatever_its_class(attrs):
    assert main_text(f"<body><div class='nav'><a>Home</a></div><div {attrs}>{ARTICLE}</div><div class=footer>Legal, 2024.</div></body>") == f"T {LONG} {LONG}"
    assert main_text(f"<body><div {attrs}><div class='nav'><a>Home</a></div>{ARTICLE}<div class='post-comments'><p>{LONG}</p></div></div></body>") == f"T {LONG} {LONG}"


def test_marked_parts_of_an_article():
    inner = "<table class='side-by-side'><tr><td>a<td>b</table><p>at <span class='share-price'>12</span> now</p><div class='share-buttons'>Tell</div><div class='site-sidebar'>Links</div>"
    assert main_text(f"<article>{ARTICLE}{inner}</article>") == f"T {LONG} {LONG} a b at 12 now"
    assert main_text(f"<form id=aspnetForm><div class=menu>Menu</div>{ARTICLE}</form>") == f"T {LONG} {LONG}"


def test_marked_elements_are_dropped_beside_the_text():
    assert main_text(f"<div><h1>T</h1><p>{LONG}</p></div><div class='comments'>{f'<p>{LONG}</p>' * 9}</div>") == f"T {LONG}"
    assert main_text("<div class='menu'>Home, news.</div>") == ""
    assert main_text(f"<div class='comments'><article>{LONG * 9}</article></div><main><p>{LONG}</p></main>") == LONG


def test_main_text_takes_time_in_proportion_to_marks():
    start = time.time()
    for page in ("<div class=ad>" * 30_000 + LONG, f"<div class=ad><p>{LONG}" * 10_000, "<p class=a-" + "ad-" * 50_000 + ">x", "<p " + "a=" * 50_000 + ">x", "<p " + "class " * 50_000 + ">x"):
        main_text(page)
    assert time.time() - start < 30


def test_main_text_takes_time_in_proportion():
    start = time.time()
    for page in ("<b>" * 40_000 + "x" + "<p>y" * 40_000 + "</i>" * 40_000, "<" * 100_000, "<a " * 50_000, "<div><p>" * 30_000, "<!--" * 50_000, "</p>" * 50_000, "<a b='" * 30_000):
        main_text(page)
    assert time.time() - start < 30


def test_main_texts_table(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{LONG}</article>", 5), (1, "u", None, 6), (None, None, "<p>a", 7)], "page_id long, url string, html string, text int")
    got = main_texts(pages, carry=["page_id", "url"]).collect()
    assert Counter((r.page.page_id, r.text) for r in got) == Counter([(1, LONG), (1, ""), (None, "a")])
    assert main_texts(pages.limit(0)).count() == 0


def test_given_pages_give_their_article(spark):
    import html
    import re

    for r in table(spark, FOLDER, "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>|<br>", re.sub(r"</?b>", "", inner))
        assert main_text(r.html) == " ".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))


# ------------------------------------------------------------------------------------------------- models


def docs_with(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1.0, 2, "d", 3, [4]) for i, t, lang in rows], f"doc_id long, text string, lang string, {CLASH}")


ODD = [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", "de"), (4, "x", None), (None, "words of a row", "en"), (5, "long " * 40_000, "en"), (5, "long " * 40_000, "en")]


def test_language_of_held_out_rows(spark):
    docs = table(spark, FOLDER, "documents")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.of_known_language(docs)
    assert kept.columns == docs.columns and kept.count() > 0.98 * docs.where(F.col("text").rlike(r"\p{L}")).count()


FOREIGN = [
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει μακριά στο δάσος",
    "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в тёмный лес",
    "敏捷的棕色狐狸跳过了懒狗然后跑进了森林里面",
    "qzxv wkjh pqrx zzkq vvxw jjkq xqzv kwjx qqzz",
]


def test_unlearned_languages_and_noise_are_rejected_and_no_learned_text(spark):
    docs = table(spark, FOLDER, "documents")
    model = language_id.train(docs.where(language_id.in_training()))
    _, _, rejected = model.predict(pa.array([*FOREIGN, "x " * 50_000 + FOREIGN[0] * 3000]))
    assert rejected.all()
    out = language_id.predictions(docs, model, ["doc_id", "text"]).select("doc.text", "rejected").collect()
    assert sum(r.rejected for r in out if any(c.isalpha() for c in r.text or "")) <= 0.002 * len(out)


def test_calibration_documents_train_nothing(spark, monkeypatch):
    seen = {}
    descend = language_id._descend
    monkeypatch.setattr(language_id, "_descend", lambda rows, *args: seen.update(rows=[r[0].tobytes() for r in rows]) or descend(rows, *args))
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "l1" if i % 2 else "l2") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    counts = docs.mapInArrow(language_id._counts, "lang string, part int, doc long, n long, bucket binary, share binary").toPandas()
    language_id.train(docs, epochs=1)
    learned = Counter(seen["rows"])
    whole = counts[counts.part == 0]
    trained = [doc for doc, bucket in zip(whole.doc, map(bytes, whole.bucket), strict=True) if learned[bucket]]
    assert 0.6 * len(whole) < len(trained) < 0.95 * len(whole)
    assert learned == Counter(map(bytes, counts[counts.doc.isin(trained)].bucket))  # whole texts and their cuts go together


def test_language_of_odd_rows(spark):
    docs = docs_with(spark, ODD)
    got = language_id.identified(docs)
    rows = got.collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3}
    assert {r.lang_pred for r in rows} <= {"und", "en", "de"}
    assert {r.doc_id for r in language_id.of_known_language(docs).collect()} <= {4, 5, None}
    assert language_id.identified(docs.limit(0)).count() == 0
    unlabelled = language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_every_language_is_learned(spark):
    rows = [(10 * i + j, f"{chr(97 + i % 26) * 2}{chr(97 + i // 26) * 3}q " * 9, f"l{i:03d}") for i in range(230) for j in range(3 if i < 200 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, epochs=1)
    assert model.languages == sorted({r[2] for r in rows}) and model.table.shape[0] == 230


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / max(1, (y == 1).sum() * (y == 0).sum())


def test_quality_of_held_out_rows(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y = np.array([r.quality for r in got])
    assert len(got) > 50 and auc(np.array([r.score for r in got]), y) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted for r in got if r.quality == 1]) > 0.97


def test_trees_split_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = quality.grow(x, y)
    assert np.mean((trees.score(x) > 0.5) == y) > 0.97
    assert np.allclose(quality.grow(x, np.ones(2000)).score(x), quality.grow(x, np.ones(2000)).score(x[:1])[0])
    assert len(trees.score(x[:0])) == 0


def test_statistics_do_not_leak_between_texts():
    texts = ["One two two.", None, "", "A!!\nA!!\nb | c", "ünï " * 50]
    whole = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(pa.array([t], pa.string()))[0])


def test_toxicity_of_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.toxicity_scores(docs, labels).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where("held_out").collect()
    y, p = np.array([r.y for r in got]), np.array([r.predicted for r in got])
    assert (y * p).sum() / p.sum() > 0.85 and (y * p).sum() / y.sum() > 0.7
    assert all(r.toxic == bool(r.predicted) for r in got)


def test_rare_toxic_words_count_beside_frequent_clean_ones(spark):
    rng = np.random.default_rng(4)
    clean = [" ".join(f"clean{j}x" for j in np.flatnonzero(rng.random(400) < 0.5)) for _ in range(1200)]
    toxic = [" ".join([f"clean{j}x" for j in np.flatnonzero(rng.random(400) < 0.25)] + [f"bad{(4 * i + j) % 200}" for j in range(4)]) for i in range(200)]
    asked = ["neutral"] + [f"neutral bad{j}" for j in range(200)] + ["neutral clean399xyz"]
    held = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 5 == 0][: len(asked)]
    docs = spark.createDataFrame([*enumerate(clean + toxic), *zip(held, asked, strict=True)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= len(clean))) for i in range(len(clean) + len(toxic))], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).where(F.col("doc_id") >= 10_000).collect()}
    score = [got[i] for i in held]
    assert np.mean([s > score[0] for s in score[1:-1]]) > 0.95
    assert score[-1] < score[0]  # an unseen form of a clean word leans as its beginning does


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows(spark, scores):
    docs = docs_with(spark, ODD)
    labels = spark.createDataFrame([(i, q, q, "x") for i, q in [(1, 1), (2, 0), (4, None), (None, 1), (5, 1), (5, 0), (3, 0)]], "doc_id long, quality int, toxic int, text string")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        got = scores(docs, some).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        held = {r.doc_id: r.held_out for r in got}
        assert held == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in held}
    assert scores(docs.limit(0), labels).count() == 0


def test_remainder_is_of_the_id_as_text(spark):
    got = spark.range(50).select("id", remainder("id", 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_chain_feeds_categories_forward():
    rng = np.random.default_rng(2)
    x = (rng.random((600, 3)) < 0.3).astype(float)
    first = x[:, 0]
    chain = toxicity.fit(np.arange(3, dtype=np.uint64), x, np.stack([first, np.maximum(first, x[:, 1])], 1))
    assert len(chain.weights[1]) == 3 + 1 + 1 and chain.predict(x).shape == (600, 2)
    assert np.mean((chain.predict(x)[:, 1] > chain.threshold) == np.maximum(first, x[:, 1])) > 0.99
