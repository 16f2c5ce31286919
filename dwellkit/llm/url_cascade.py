"""URL filters: a cascade of Bloom filters over the hosts of a corpus, and host and path rules.

Level 1 encodes the listed hosts. The corpus's other hosts that pass it by chance are
encoded by level 2, the listed ones that pass level 2 by level 3, and so on until nothing
passes by chance. Over that universe of hosts the answer is exact, and asking takes no
join: a few bits of a few arrays. All of it is DataFrame code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.store import stored

#: 64-bit words of all levels together that a query may hold in each task (16 MB).
MOST_WORDS = 1 << 21
#: Share of strangers that pass a level by chance.
PASS_RATE = 1 / 32
DELIMITER = "://"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate(DELIMITER, url)
    return F.when(at > 0, F.substring(url, at + len(DELIMITER), F.length(url)))


def host_of(url: Column) -> Column:
    """Lower-case host: what follows the first ``://`` up to /, ?, # or the end; else empty."""
    raw = F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int


@dataclass(frozen=True)
class Cascade:
    """``words`` has a row (level, words array<long>) for each level; none: nothing is listed."""

    words: DataFrame | None
    levels: tuple[Level, ...]

    @property
    def size(self) -> int:
        return sum(level.bits for level in self.levels) // 64


def _place(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits))


def _level(keys: DataFrame, level: int, shape: Level) -> DataFrame:
    """(level, words) of the filter that holds the keys; a bit is set before rows move."""
    places = F.array(*[_place(F.col("key"), level, j, shape.bits) for j in range(shape.hashes)])
    words = (
        keys.select(F.explode(places).alias("bit"))
        .select(
            F.expr("cast(bit div 64 as long)").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits")
        )
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    slots = keys.sparkSession.range(shape.bits // 64).withColumnRenamed("id", "word")
    return (
        slots.join(words, "word", "left")
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
        .select(F.lit(level).alias("level"), F.col("w.bits").alias("words"))
    )


def _passes(key: Column, level: int, shape: Level, words: Column) -> Column:
    out = F.lit(True)
    for j in range(shape.hashes):
        at = _place(key, level, j, shape.bits)
        word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
        out = out & (F.getbit(word, (at % 64).cast("int")) == 1)
    return out


def _array(words: DataFrame, level: int) -> Column:
    """The words of a level as a value: they are read once for each task, not for each row."""
    return words.where(F.col("level") == level).select("words").scalar()


def build_cascade(universe: DataFrame, pass_rate: float = PASS_RATE, most_words: int = MOST_WORDS) -> Cascade:
    """The cascade of ``universe`` (key, listed), whose keys are distinct.

    Null keys are left out. A cascade that would take more than ``most_words`` words has
    no words at all; ``is_listed`` callers then join (see ``judge``).
    """
    hashes = max(1, round(math.log2(1 / pass_rate)))
    keys = universe.where("key is not null")
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    levels: list[Level] = []
    tables: list[DataFrame] = []
    n = inside.count()
    while n:
        shape = Level(max(64, math.ceil(n * hashes / math.log(2) / 64) * 64), hashes)
        levels.append(shape)
        if sum(x.bits for x in levels) // 64 > most_words:
            return Cascade(None, tuple(levels))
        number = len(levels)
        tables.append(stored(_level(inside, number, shape), "bloom-level"))
        passed = outside.where(_passes(F.col("key"), number, shape, _array(tables[-1], number)))
        inside, outside = stored(passed, "bloom-passed"), inside
        n = inside.count()
    words = None
    for x in tables:
        words = x if words is None else words.union(x)
    return Cascade(words, tuple(levels))


def is_listed(key: Column, cascade: Cascade) -> Column:
    """Whether a key of the universe is listed: it passes level 1, and not level 2 unless
    it passes level 3, and so on."""
    out = F.lit(False)
    for number in range(len(cascade.levels), 0, -1):
        here = _passes(key, number, cascade.levels[number - 1], _array(cascade.words, number))
        out = here & ~out
    return out


def suffixes(host: Column) -> Column:
    """The host and each domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def universe_of(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) for the distinct hosts: a host is listed if it or a domain above it is.

    hosts: (host); listed: (domain), nulls and repeats allowed.
    """
    distinct = stored(hosts.where("host <> ''").select("host").distinct(), "hosts")
    domains = listed.select("domain").where("domain is not null").distinct()
    hit = (
        distinct.select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
        .join(domains, "domain", "left_semi")
        .select("host")
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    both = distinct.join(hit, "host", "left")
    return stored(both.select(F.col("host").alias("key"), F.coalesce("listed", F.lit(False)).alias("listed")), "universe")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does. A rule
    (verdict, host, path) fits its host and all subdomains where the path starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    pass_rate: float = PASS_RATE,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """(id, host, path, rule, verdict, listed) for each row of pages.

    verdict: that of the longest rule that fits; else block where the host is listed or
    lies below a listed domain, allow otherwise. A url that is null or has no ``://`` has
    an empty host and path, fits no rule with a host and is allowed. Repeated rows are
    judged each; null ids stay null; an empty list blocks nothing. Only the named columns
    are read. The cascade covers the hosts of exactly these pages, so it is exact here. Where
    its arrays would be larger than ``most_words`` words, hosts are joined with the list.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    universe = universe_of(parsed.select("host"), listed)
    cascade = build_cascade(universe, pass_rate, most_words)
    if cascade.levels and cascade.words is None:
        marked = parsed.join(
            universe.where("listed").select(F.col("key").alias("host"), F.lit(True).alias("on_list")), "host", "left"
        )
        hit = F.coalesce("on_list", F.lit(False))
    else:
        marked, hit = parsed, is_listed(F.col("host"), cascade)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    blocked = (F.col("host") != "") & hit
    return marked.select(
        id_col,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        blocked.alias("listed"),
    )
