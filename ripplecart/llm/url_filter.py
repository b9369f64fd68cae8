"""URL rules by a Bloom filter cascade, in DataFrame functions alone.

A rule is (host, path): it fits the host and its subdomains where the url's path starts with the rule's. The keys a
url could match are its host suffixes joined with the prefixes of its path that have the length of some rule's path.
Level 1 of a cascade encodes the listed keys. Level 2 encodes the false positives of level 1 among all keys of the
corpus, level 3 the listed keys that pass level 2, and so on until a level lets nothing wrong through. A key of the
corpus is listed exactly when the first level that refuses it has an even number, or none
refuses it and the number of levels is odd: exact membership from a few bit arrays, without a join.

Only keys that pass level 1 are ever gathered, so building shuffles the listed keys' share of the universe and the
false positives, about 0.2 % of the rest.

Up to MOST_BYTES a level's bit array is a literal in the plan and urls are judged where they lie. A longer list is cut by
key hash into segments of a few kilobytes, each with its own arrays of all levels; the corpus' keys meet their segment in a
shuffled join, so no list is too long and nothing of its size is held in one place.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecart.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits a key in the first level and in the later ones, and hashes in each.
FIRST, LATER = (13, 9), (6, 4)
#: Largest bit array of a level in bytes that travels as a literal with every task; longer lists are cut into segments.
MOST_BYTES = 4 << 20
#: 64-bit words of a segment's first level.
SEGMENT_WORDS = 1024


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none or the url is null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys of a url, host suffix # path prefix, for each length of a rule's path that its path has; neither holds a #."""
    if not lengths:
        return F.array().cast("array<string>")
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    return F.flatten(F.transform(_suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("#"), p))))


class Bloom:
    """A bit array as a literal of 64-bit words; `has` is its test as a column expression."""

    def __init__(self, words: list[int], size: int, hashes: int, seed: int):
        self.words, self.size, self.hashes, self.seed = words, size, hashes, seed

    @staticmethod
    def places(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(seed * 101 + i)), F.lit(size)) for i in range(hashes)]

    @classmethod
    def of(cls, keys: DataFrame, n: int, per_key: int, hashes: int, seed: int) -> Bloom:
        """Over the distinct values of column `key`, n of them."""
        size = max(1, math.ceil(n * per_key / 64)) * 64
        at = keys.select(F.explode(F.array(*cls.places(F.col("key"), size, hashes, seed))).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        array = [0] * (size // 64)
        for w, bits in words.collect():
            array[w] = bits
        return cls(array, size, hashes, seed)

    def has(self, key: Column) -> Column:
        held = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded into one literal
        tests = (F.getbit(F.get(held, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in self.places(key, self.size, self.hashes, self.seed))
        return reduce(Column.__and__, tests)


class Cascade:
    """Exact membership of the universe's keys among the listed ones."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def of(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """Both with a column `key`; repeated and null keys are allowed, null is never listed."""
        inside = saved(listed.where("key is not null").select("key").distinct(), "listed")
        levels, n, outside = [], inside.count(), universe
        while n:
            per_key, hashes = LATER if levels else FIRST
            levels.append(level := Bloom.of(inside, n, per_key, hashes, len(levels)))
            passing = outside.where(level.has(F.col("key"))).select("key").distinct()
            if len(levels) == 1:  # the universe holds listed keys too
                passing = passing.join(inside, "key", "left_anti")
            passing = saved(passing, "passing")
            inside, outside, n = passing, inside, passing.count()
        return cls(levels)

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the parity of the levels that it passes before one refuses it."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.has(key), out).otherwise(F.lit(i % 2 == 1))
        return out


class SegmentedCascade:
    """The same cascade over segments of the keys: a row per segment with the words of every level."""

    def __init__(self, table: DataFrame, levels: list[tuple[str, int, int, int]], segments: int):
        self.table, self.levels, self.segments = table, levels, segments

    @classmethod
    def of(cls, listed: DataFrame, universe: DataFrame, words: int = SEGMENT_WORDS) -> SegmentedCascade:
        """Both with a column `key`; repeated and null keys are allowed, null is never listed."""
        inside = saved(listed.where("key is not null").select("key").distinct(), "listed")
        n, outside = inside.count(), universe.where("key is not null").select("key").distinct()
        segments = max(1, math.ceil(n * FIRST[0] / 64 / words))
        spark, levels = listed.sparkSession, []
        table = spark.range(segments).select(F.col("id").alias("segment"))
        while n:
            per_key, hashes = LATER if levels else FIRST
            name, size = f"words{len(levels)}", max(1, math.ceil(n * per_key / segments / 64)) * 64
            levels.append((name, size, hashes, len(levels)))
            at = inside.select(cls._segment(segments).alias("segment"), F.explode(F.array(*Bloom.places(F.col("key"), size, hashes, len(levels) - 1))).alias("at"))
            bits = at.groupBy("segment", F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
            held = bits.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))  # at most a segment's words
            dense = F.transform(F.sequence(F.lit(0), F.lit(size // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
            made = held.select("segment", dense.alias(name))
            table = saved(table.join(made, "segment", "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0).cast("bigint"), size // 64))), "segments")
            passing = cls._met(outside, table, segments).where(cls._has(levels[-1])).select("key").distinct()
            if len(levels) == 1:  # the universe holds listed keys too
                passing = passing.join(inside, "key", "left_anti")
            passing = saved(passing, "passing")
            inside, outside, n = passing, inside, passing.count()
        return cls(table, levels, segments)

    @staticmethod
    def _segment(segments: int) -> Column:
        return F.pmod(F.xxhash64("key", F.lit("segment")), F.lit(segments))

    @classmethod
    def _met(cls, keys: DataFrame, table: DataFrame, segments: int) -> DataFrame:
        return keys.withColumn("segment", cls._segment(segments)).join(table.hint("merge"), "segment")

    @staticmethod
    def _has(level: tuple[str, int, int, int]) -> Column:
        name, size, hashes, seed = level
        tests = (F.getbit(F.get(name, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in Bloom.places(F.col("key"), size, hashes, seed))
        return reduce(Column.__and__, tests)

    def marked(self, keys: DataFrame, column: str) -> DataFrame:
        """`keys` of the universe with a boolean column that says which are listed; a null key is not."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(self._has(level), out).otherwise(F.lit(i % 2 == 1))
        return self._met(keys, self.table, self.segments).withColumn(column, F.col("key").isNotNull() & out).drop("segment", *[x[0] for x in self.levels])


def _segmented_verdicts(keyed: DataFrame, keys: Column, rules: DataFrame) -> DataFrame:
    """`keyed` with _best, a struct of the longest listed key and whether it blocks, by way of the segments."""
    rows = saved(keyed.withColumn("_url", F.monotonically_increasing_id()), "keyed")
    asked = rows.select("_url", F.explode(keys).alias("key"))
    universe = asked.select("key").distinct()
    listed = SegmentedCascade.of(rules, universe).marked(universe, "listed").where("listed").drop("listed")
    judged = SegmentedCascade.of(rules.where("block"), rules).marked(saved(listed, "fitting"), "block")
    longest = F.max(F.struct(F.length("key").alias("n"), F.instr("key", "#").alias("h"), "key", "block"))
    best = asked.join(judged, "key").groupBy("_url").agg(longest.alias("_best"))
    return rows.join(best, "_url", "left").drop("_url")


def url_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of `urls` with _host, _path, _rule and _verdict.

    `rules` has columns host, path (both as they are written in `host` + `path`) and verdict. The longest fitting rule
    wins (characters of host and path together, then of the host); a rule given both ways blocks. A url that no rule
    fits, a null url and one without :// get a null rule and `default`. Rules with a null host or path count as
    empty strings. Empty tables give an empty result, or `default` everywhere. Very long urls are read whole; repeated rows are
    judged alike. Columns of `urls` with one of the four names are replaced, others carried whatever their names.
    """
    spark = urls.sparkSession
    rules = saved(
        rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").select(
            F.concat("host", F.lit("#"), "path").alias("key"), F.length("path").alias("n"), (F.col("verdict") == "block").alias("block")
        ),
        "rules",
    )
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())
    kept = [c for c in urls.columns if c not in ("_host", "_path", "_rule", "_verdict")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(True).alias("none"))
    keyed = urls.select(row.alias("row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    out = [*[F.col(f"row.`{c}`") for c in kept], "_host", "_path", "_rule", "_verdict"]
    keys = candidates(F.col("_host"), F.col("_path"), lengths)
    if math.ceil(rules.select("key").distinct().count() * FIRST[0] / 8) > most_bytes:
        found = _segmented_verdicts(keyed, keys, rules)
        verdict = F.when(F.col("_best").isNull(), default).when(F.col("_best.block"), "block").otherwise("allow")
        return found.withColumn("_rule", F.translate("_best.key", "#", "")).withColumn("_verdict", verdict).select(*out)
    universe = keyed.select(F.explode(keys).alias("key"))
    listed = Cascade.of(rules, universe)
    blocked = Cascade.of(rules.where("block"), rules)
    longest = F.array_max(F.transform(F.filter(keys, listed.has), lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "#").alias("h"), k.alias("key"))))
    verdict = F.when(F.col("_best").isNull(), default).when(blocked.has(F.col("_best")), "block").otherwise("allow")
    return keyed.withColumn("_best", longest["key"]).withColumn("_rule", F.translate("_best", "#", "")).withColumn("_verdict", verdict).select(*out)


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")
