"""Secret scan over a ledger of content-addressed blobs, in DataFrame functions alone.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a folder of Parquet batches in shared
storage, says which blob was scanned by which rule version and what was found. A run addresses all versions, takes
the (blob, rule version) pairs that the ledger lacks, scans each such blob once whatever the number of paths and
versions that hold it, adds one batch, and joins the findings back to all paths.

Spans come from the text between the hits and the hits themselves: their lengths, summed in order, are positions. Hits
are summed as rows of a window, so a text with a million hits is no quadratic list.

A blob that a third of all versions share is reduced before the shuffle; findings meet the versions under a salt.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplecart.functions.distributed import broadcast_if_small
from ripplecart.llm.common import saved, scratch

#: Copies of each finding row, so that the versions of one blob meet it in several tasks.
SALTS = 16

HITS = "array<struct<rule: string, hits: array<struct<gap: bigint, size: bigint, measured: bigint>>>>"
LEDGER = "blob string, scanned array<string>, spans array<struct<rule: string, start: bigint, end: bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: hits of `pattern` whose group `group` has `least` characters or more. A new version scans all blobs anew."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: A run of at least n characters of a class is what the class with + finds, less the shorter runs.
RULES = [
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
]


def _hits(rules: list[Rule], seen: Column | None) -> Column:
    """Per rule that finds anything: the characters before each hit since the last, of the hit, and of its measured group."""
    found = []
    for rule in rules:
        lengths = lambda pieces: F.transform(pieces, lambda s: F.length(s).cast("long"))
        pattern = F.lit(rule.pattern)
        hit = F.struct(
            F.lit(rule.name).alias("rule"),
            F.arrays_zip(
                lengths(F.slice(F.split("text", rule.pattern), 1, F.regexp_count("text", pattern))).alias("gap"),
                lengths(F.regexp_extract_all("text", pattern, F.lit(0))).alias("size"),
                lengths(F.regexp_extract_all("text", pattern, F.lit(rule.group))).alias("measured"),
            ).alias("hits"),
        )
        wanted = F.col("text").rlike(rule.pattern)
        found.append(F.when(wanted if seen is None else ~F.array_contains(seen, rule.name) & wanted, hit))
    return F.filter(F.array(*found).cast(HITS), lambda h: h.isNotNull())


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """All batches of a ledger; None where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)


def scan_unseen(texts: DataFrame, rules: list[Rule], ledger: str) -> DataFrame:
    """Scan the blobs of `texts` (blob, text) by the rules that the ledger at `ledger` has not seen on them; add one batch.

    Returns the whole ledger. A batch is one write, so a run that dies leaves no half batch that is read: files appear
    with the job's commit.
    """
    spark = texts.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules]).cast("array<string>")
    known, seen = read_ledger(spark, ledger), None
    if known is not None:
        per_blob = known.select("blob", F.explode("scanned").alias("s")).groupBy("blob").agg(F.collect_set("s").alias("seen"))
        partly = texts.select("blob").distinct().join(per_blob, "blob", "left")
        lacking = partly.where(F.size(F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))) > 0)
        todo, _ = broadcast_if_small(lacking.select("blob", F.coalesce("seen", F.array().cast("array<string>")).alias("seen")))
        texts, seen = texts.join(todo, "blob"), F.col("seen")
    once = texts.dropDuplicates(["blob"])
    lack = names if seen is None else F.array_except(names, seen)
    hits = saved(once.select("blob", lack.alias("scanned"), _hits(rules, seen).alias("hits")), "hits")

    one = hits.select("blob", F.inline("hits")).select("blob", "rule", F.posexplode("hits").alias("i", "h"))
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("h.gap") + F.col("h.size")).over(upto)
    spans = one.select("blob", "rule", "h.size", "h.measured", end.alias("end"))
    enough = F.lit(False)
    for rule in rules:
        enough = enough | ((F.col("rule") == rule.name) & (F.col("measured") >= rule.least))
    spans = spans.where(enough).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end"))).alias("spans"))
    batch = hits.select("blob", "scanned").join(spans, "blob", "left")
    batch.write.option("compression", "zstd").parquet(f"{ledger.rstrip('/')}/batch-{uuid.uuid4().hex}")
    return read_ledger(spark, ledger)


def scan_versions(versions: DataFrame, rules: list[Rule] | None = None, ledger: str | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per version: the struct `version` of its `carry` columns, blob, and spans (kind, start, end) by start, then rule order.

    Starts and ends are code points, the end exclusive; hits of one rule are leftmost and don't overlap, hits of different rules may.
    Without a `ledger` folder the run begins a new one in the shared scratch folder. Findings of rule versions that are
    not among `rules` stay in the ledger and out of the result. The ledger adds no spans of its own.

    A null text counts as empty and has no findings; null, tied and repeated carried values are rows like others, each
    version answers for itself. Texts of any length are scanned whole. Other columns are not read, whatever their names.
    An empty table gives no rows (and an empty batch).
    """
    rules = RULES if rules is None else rules
    ledger = ledger or scratch(versions.sparkSession, "ledger")
    content = F.coalesce(F.col(text), F.lit(""))
    blob = F.sha2(content.cast("binary"), 256)
    paths = versions.select(F.struct(*(carry if carry is not None else ["doc_id"])).alias("version"), blob.alias("blob"))
    known = scan_unseen(versions.select(blob.alias("blob"), content.alias("text")), rules, ledger)

    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))]).cast("map<string, int>")
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))]).cast("map<string, string>")
    hits = known.select("blob", F.inline("spans")).where(F.col("rule").isin([r.name for r in rules]))
    ranked = F.array_sort(F.collect_list(F.struct("start", order[F.col("rule")].alias("rank"), "end", kinds[F.col("rule")].alias("kind"))))
    found = hits.groupBy("blob").agg(ranked.alias("found"))
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = paths.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    spans = F.transform(F.coalesce("found", F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return dealt.join(salted, ["blob", "salt"], "left").select("version", "blob", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
