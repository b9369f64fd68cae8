"""The thirteen operators and the pipeline as named queries over the given tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ripplecart.llm.common import table
from ripplecart.llm.decontaminate import benchmark_matches
from ripplecart.llm.exact_dedup import exact_groups
from ripplecart.llm.html_text import main_texts
from ripplecart.llm.language_id import identified
from ripplecart.llm.merkle import leaf_digest, manifest, proof_digest, with_folded
from ripplecart.llm.ngram_join import jaccard_components
from ripplecart.llm.packing import pack_documents
from ripplecart.llm.quality import quality_scores
from ripplecart.llm.secret_scan import RULES as SECRETS, joined, scan_versions
from ripplecart.llm.substring_dedup import repeated_spans
from ripplecart.llm.token_alignment import aligned
from ripplecart.llm.toxicity import toxicity_scores
from ripplecart.llm.url_filter import rules_of, url_verdicts

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents")).drop("spans")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = main_texts(table(spark, folder, "pages"), carry=["page_id", "url"])
    return texts.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = url_verdicts(pages, rules_of(spark, RULES))
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identified(table(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), n=3, num=90, den=100)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10, carry=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_versions(table(spark, folder, "documents"), SECRETS)
    of_kind = [F.size(F.filter("spans", partial(_is_kind, kind))).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    spans = joined(F.col("spans"))
    return found.select("version.doc_id", *of_kind, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs, columns = table(spark, folder, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_digest(*[lowered if c == "text" else F.col(c) for c in columns])
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proofs = manifest(docs, columns, carry={"tampered": F.when(third, tampered)}).proofs()
    return with_folded(proofs, F.col("tampered")).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned(table(spark, folder, "documents")).docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_text": op3_html_text,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_join": op9_ngram_join,
    "op10_decontamination": op10_decontamination,
    "op11_secret_scan": op11_secret_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A value as the leaf holds it.
_VALUE = "CASE WHEN {} IS NULL THEN '-' ELSE octet_length(encode(CAST({} AS VARCHAR))) || ':' || CAST({} AS VARCHAR) END".replace("{}", "{0}")

#: crc32 of the decimal doc_id before its last inversion: eight shifts for each of its characters.
_CRC = (
    "list_reduce([4294967295] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
)

SQL = {
    "op1_substring_dedup": r"""
        WITH t AS (
            SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), w AS (
            SELECT r, unnest(range(0, n - 199)) AS i, x FROM t WHERE n >= 200
        ), k AS (
            SELECT r, i, md5_number(substring(x, 2 * i + 1, 400)) AS h FROM w
        ), again AS (
            SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1
        ), marked AS (
            SELECT r, i, CASE WHEN i <= max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200 THEN 0 ELSE 1 END AS new FROM again
        ), spans AS (
            SELECT r, s, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS s FROM marked) GROUP BY r, s
        ), lists AS (
            SELECT r, sum(b - a) AS gone, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY r
        ), kept AS (
            SELECT t.r, string_agg(substring(x, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS x FROM (
                SELECT t.r, t.x, unnest([0] || l.ends) AS p, unnest(l.starts || [t.n]) AS q FROM t JOIN lists l USING (r)
            ) t GROUP BY t.r
        )
        SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(l.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(l.spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept.x, t.x))) AS kept_sha256
        FROM t LEFT JOIN lists l USING (r) LEFT JOIN kept USING (r)
    """,
    "op2_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_code_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), r AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_code_points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_code_points FROM r
    """,
    "op5_url_filter": r"""
        WITH u AS (
            SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ), h AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u
        ), rules(verdict, host, path) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), m AS (
            SELECT h.page_id, h.host, h.path, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
            FROM h LEFT JOIN rules r ON (h.host = r.host OR suffix(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
    "op9_ngram_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), o AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)
        ), e AS (
            SELECT x, y FROM l UNION ALL SELECT y, x FROM l
        ), r(doc_id, c) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
        )
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
    """,
    "op10_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), i AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), t AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
        ), sizes AS (
            SELECT DISTINCT n FROM t
        ), q AS (
            SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
        ), h AS (
            SELECT q.doc_id, q.p, q.n, t.item FROM q JOIN t ON q.g = t.g AND q.n = t.n
        ), words AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM h) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_secret_scan": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
        ), rules(k, kind, pattern, grp, least) AS (
            VALUES (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
                   (1, 'access', 'AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '[0-9a-f]+', 0, 32)
        ), m AS (
            SELECT r, 0 AS k, 'assign' AS kind, 8 AS least, string_split_regex(t, p) AS gaps, regexp_extract_all(t, p) AS hits, regexp_extract_all(t, p, 2) AS held
            FROM d, (SELECT pattern AS p FROM rules WHERE k = 0)
            UNION ALL SELECT r, k, kind, least, string_split_regex(t, pattern), regexp_extract_all(t, pattern), regexp_extract_all(t, pattern) FROM d, rules WHERE k > 0
        ), e AS (
            SELECT r, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(held) AS held FROM m WHERE len(hits) > 0
        ), x AS (
            SELECT r, k, kind, length(held) >= least AS ok, length(hit) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM e
        ), s AS (
            SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
                   string_agg(kind || ':' || CAST(stop - n AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY stop - n, k) AS spans
            FROM x WHERE ok GROUP BY r
        )
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN s USING (r)
    """,
    "op12_merkle_manifest": rf"""
        WITH RECURSIVE v AS (
            SELECT *, {LOWER.replace("coalesce(text, '')", "text")} AS low FROM documents
        ), d AS (
            SELECT doc_id, coalesce('1' || lang, '0') AS tree,
                   sha256({" || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
                   sha256({" || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "low"))}) AS altered
            FROM v
        ), thirds AS (
            SELECT DISTINCT doc_id, coalesce(xor({_CRC}, 4294967295) % 3 = 0, false) AS crc32_third FROM documents
        ), l AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
        ), lower_nodes(tree, lvl, pos, n, h) AS (
            SELECT tree, 0, pos, n, leaf FROM l
            UNION ALL SELECT tree, lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_nodes WHERE n > 1 GROUP BY tree, lvl, pos // 8
        ), subroots AS (
            SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lower_nodes WHERE n = 1
        ), upper_nodes(lvl, pos, n, h) AS (
            SELECT 0, pos, n, h FROM subroots
            UNION ALL SELECT lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 8
        ), lower_runs AS (
            SELECT tree, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM lower_nodes WHERE n > 1 GROUP BY ALL
        ), upper_runs AS (
            SELECT lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM upper_nodes WHERE n > 1 GROUP BY ALL
        ), climb(doc_id, tree, leaf, lvl, pos, n, cur, proof) AS (
            SELECT doc_id, tree, leaf, 0, pos, n, CASE WHEN crc32_third THEN altered ELSE leaf END, '' FROM l JOIN thirds USING (doc_id)
            UNION ALL
            SELECT doc_id, tree, leaf, lvl + 1, pos // 8, (n + 7) // 8, sha256(array_to_string(hs[1:pos % 8] || [cur] || hs[pos % 8 + 2:], '')),
                   proof || array_to_string(hs[1:pos % 8] || hs[pos % 8 + 2:], '')
            FROM climb JOIN lower_runs USING (tree, lvl) WHERE n > 1 AND run = pos // 8
        ), above(doc_id, tree, leaf, subroot, lvl, pos, n, cur, proof) AS (
            SELECT c.doc_id, c.tree, c.leaf, s.h, 0, s.pos, s.n, c.cur, c.proof FROM climb c JOIN subroots s USING (tree) WHERE c.n = 1
            UNION ALL
            SELECT doc_id, tree, leaf, subroot, lvl + 1, pos // 8, (n + 7) // 8, sha256(array_to_string(hs[1:pos % 8] || [cur] || hs[pos % 8 + 2:], '')),
                   proof || array_to_string(hs[1:pos % 8] || hs[pos % 8 + 2:], '')
            FROM above JOIN upper_runs USING (lvl) WHERE n > 1 AND run = pos // 8
        )
        SELECT doc_id, leaf, subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root, sha256(proof) AS proof_sha256, cur AS folded_root,
               cur = (SELECT h FROM upper_nodes WHERE n = 1) AS verified
        FROM above WHERE n = 1
    """,
}
