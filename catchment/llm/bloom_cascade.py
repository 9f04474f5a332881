"""URL filters: exact membership by a cascade of Bloom filters, without a join at lookup.

Level 1 encodes the listed keys; level 2 the other keys of the universe that level 1 takes for listed;
level 3 the listed keys that level 2 takes for others; and so on until a level has no false positive.
A key of the universe is listed if the first level that rejects it has an even number. Filters are
literals of the lookup expression. A cascade holds about `max_keys` listed keys; a longer list is cut by hash
into more cascades, of which `per_pass` stand in one expression and the rest in further passes over their own
part of the rows. Level 1's rate follows the universe: it takes fewer others for listed than there are listed
keys, so all levels together have max_keys * (1.44 log2(universe / listed) + some 12) bits, whatever the number of other keys.
Built-in expressions only.

A null url, or one without ://, has an empty host and path. Such keys, like any other, are exact as long
as they were in the universe. A null key is never listed. Repeated keys count once; listed keys outside of the universe
do no harm. An empty list allows everything; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import shared

#: rule (host and path prefix), verdict
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: The query's list stands in for a block list: keys below hosts with one of these labels, and keys whose MD5 begins with LISTED_MD5, which no host or path tells.
LISTED_MD5 = "0"
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host(url: Column) -> Column:
    return F.coalesce(shared.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str) -> Column:
    """Whether a rule fits columns host and path: its host or a subdomain, and the path's start."""
    name, slash, rest = rule.partition("/")
    return ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)


def longest_rule(rules, what: int) -> Column:
    """The text (0) or the verdict (1) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0])):
        found = F.when(fits(rule[0]), rule[what]).otherwise(found)
    return found


class Level:
    """One Bloom filter: bit i of word w is set if a key hashes to 64 w + i."""

    def __init__(self, keys: DataFrame, count: int, rate: float, salt: int, max_bits: int = 1 << 30):
        self.bits = min(max_bits, 64 * max(1, math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64)))
        self.hashes, self.salt = max(1, round(-math.log2(rate))), salt
        at = keys.select(F.explode(F.array(*self.places())).alias("at"))
        words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
        words = dict(map(tuple, words.collect()))  # at most bits / 64 rows, bounded by max_keys
        self.words = [words.get(i, 0) for i in range(self.bits // 64)]

    def places(self, key: Column | str = "key") -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(64 * self.salt + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column | str = "key") -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded into one literal by the optimiser
        tests = [F.get(words, F.floor(p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0 for p in self.places(key)]
        held = tests[0]
        for t in tests[1:]:
            held = held & t
        return held


class Cascade:
    """Exact membership over a universe (column key, distinct) of the listed keys (column key, distinct)."""

    def __init__(self, universe: DataFrame, listed: DataFrame, work: str, salt: int = 0, rate: float = 0.02):
        self.levels: list[Level] = []
        put, count, others = listed, listed.count(), universe.count()
        while count:
            # of the first level, fewer false positives than listed keys
            first = min(rate, 0.7 * count / max(1, others))
            self.levels.append(Level(put, count, rate if self.levels else first, salt + len(self.levels)))
            if len(self.levels) == 1:
                wrong = universe.where(self.levels[0].holds()).join(listed, "key", "left_anti")
            else:
                wrong = other.where(self.levels[-1].holds())
            wrong = shared.stash(wrong, f"{work}/false-{salt}-{len(self.levels)}")
            put, other, count = wrong, put, wrong.count()
            if len(self.levels) > 60:
                raise ValueError("keys that no filter can tell apart")

    def bits(self) -> int:
        return sum(level.bits for level in self.levels)

    def listed(self) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            found = F.when(level.holds(), found).otherwise(F.lit(i % 2 == 1))
        return found


class CascadeFilter:
    """Cascades over any number of listed keys, cut by hash so that each holds about max_keys at most."""

    def __init__(self, universe: DataFrame, listed: DataFrame, work: str, max_keys: int = 100_000, per_pass: int = 8):
        listed = shared.stash(listed.select("key").where("key IS NOT NULL").distinct(), f"{work}/all-listed")
        self.parts = max(1, math.ceil(listed.count() / max_keys))
        keys = universe.select("key").where("key IS NOT NULL").distinct()
        self.universe, self.list = (self.cut(df, f"{work}/{name}") for df, name in ((keys, "universe"), (listed, "listed")))
        self.work, self.per_pass, self.cascades = work, per_pass, {}

    def part(self) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(self.parts)).cast("int")

    def cut(self, keys: DataFrame, path: str) -> DataFrame:
        """keys written in folders by part, so that a cascade reads its own."""
        keys.withColumn("part", self.part()).write.partitionBy("part").parquet(path)
        return keys.sparkSession.read.schema("key string, part int").parquet(path)

    def cascade(self, part: int) -> Cascade:
        if part not in self.cascades:
            universe, listed = (df.where(F.col("part") == part).select("key") for df in (self.universe, self.list))
            self.cascades[part] = Cascade(universe, listed, self.work, salt=1000 * part)
        return self.cascades[part]

    def mark(self, rows: DataFrame) -> DataFrame:
        """rows (with a column key) and their boolean `listed`, which replaces a column of that name."""
        out = None
        for low in range(0, self.parts, self.per_pass):
            found = F.lit(False)
            for p in range(low, min(self.parts, low + self.per_pass)):
                found = F.when(self.part() == p, self.cascade(p).listed()).otherwise(found)
            here = F.coalesce(self.part(), F.lit(0))
            some = rows.where((here >= low) & (here < low + self.per_pass)) if self.parts > self.per_pass else rows
            some = some.withColumn("listed", F.coalesce(found & F.col("key").isNotNull(), F.lit(False)))
            out = some if out is None else out.unionByName(some)
        return out


def url_keys(pages: DataFrame) -> DataFrame:
    """page_id, host, path, key (host and path) of each page."""
    return pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("key", F.concat("host", "path"))


def judge_urls(pages: DataFrame, listed: DataFrame, work: str, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. listed: a table whose column key holds the blocked hosts and paths."""
    urls = url_keys(pages)
    marked = CascadeFilter(urls, listed, work).mark(urls)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", longest_rule(rules, 0).alias("rule"), F.coalesce(longest_rule(rules, 1), own).alias("verdict"))


def block_list(urls: DataFrame) -> DataFrame:
    """The query's listed keys, drawn from the corpus."""
    named = F.exists(F.split("host", r"\."), lambda label: label.isin(*LISTED_LABELS))
    return urls.where(named | F.md5(F.col("key").cast("binary")).startswith(LISTED_MD5)).select("key").distinct()


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, work = shared.table(spark, sf_dir, "pages").select("page_id", "url"), shared.work_dir(spark, "url-cascade")
    listed = shared.stash(block_list(url_keys(pages)), f"{work}/list")
    return judge_urls(pages, listed, work)


SQL = """
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
    WHEN md5(host || path) LIKE '0%' THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
