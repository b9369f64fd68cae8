"""The pipeline stage by stage against brute force, each on what its predecessor kept."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_pairs import brute_components, hits

import corpus_pipeline
from ripplecart.llm.common import saved, table

FOLDER = "/root/testdata/sf0.001"
SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = saved(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert out.columns == docs.columns
            after = {r.doc_id: r.text for r in out.collect()}
            assert all(before[d] == t for d, t in after.items())
            kept[name] = before, after
            docs = out
    before, after = kept["language"]
    assert len(after) >= 0.98 * sum(any(c.isalpha() for c in t or "") for t in before.values())
    before, after = kept["exact_dedup"]
    groups = defaultdict(list)
    for d, t in before.items():
        groups[(t or "").translate(SPACE)].append((-len(t or ""), d))
    assert set(after) == {min(g)[1] for g in groups.values()}
    before, after = kept["near_dedup"]
    assert set(after) == {d for d, _, c in brute_components(sorted(before.items()), 5, 80, 100) if d == c}
    before, after = kept["decontamination"]
    assert set(after) == {d for d, t in before.items() if not hits(t, items, 10)[1]}
    pieces = out.collect()
    assert {p.doc_id for p in pieces} == set(after)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert max(p.offset + p.length for p in pieces) <= 2048
    assert np.mean([p.length for p in pieces]) > 0


def test_run_gives_the_packed_corpus(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_take_nulls_repeated_ids_and_clashing_columns(spark):
    docs = table(spark, FOLDER, "documents").limit(60)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(6).collect()]
    odd = [(None, texts[0]), (None, texts[0]), (None, texts[1] + " "), (7, texts[2] + " tail"), (7, texts[3]), (7, None), (None, ""), (None, None), (9, "123 456"), (10, texts[4] * 50)]
    rows = spark.createDataFrame([(i, t, "en", None, None) for i, t in odd], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows)
    for name in ("row", "doc", "h", "key", "label", "spans", "_th", "th"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert docs.columns == before.columns and docs.count() > 20
            assert docs.where("row <> 'row' or th <> 'th'").count() == 0
        if name == "language":
            assert docs.where("text is null or text = '' or text = '123 456'").count() == 0
        if name == "exact_dedup":
            kept = [r.text.translate(SPACE) for r in docs.collect()]
            assert len(kept) == len(set(kept))
        if name == "near_dedup":
            assert all(d == c for d, _, c in brute_components(list(enumerate(r.text for r in docs.collect())), 5, 80, 100))
    assert docs.columns[:2] == ["doc_id", "start"] and docs.count() > 20


def test_stages_take_empty_tables(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, FOLDER), name)
        assert out.count() == 0
        docs = docs if name == "packing" else out
