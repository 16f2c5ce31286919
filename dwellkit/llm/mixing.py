"""Mixing sources to target weights by repeating documents.

Words are added up per source; a source's target over its words is its repetition rate. Each
document is emitted floor(rate) times, and once more where a number drawn from the hash of its
id and text is below the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.columns import lookup
from dwellkit.llm.store import stored
from dwellkit.operators.prefix import before, join_totals

# Weights of the sources in order, their share of all words, most repetitions.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Hex digits of the hash that make the drawn number; 13 digits are 52 bits, exact in a double.
DIGITS = 13
_KEYS = ["source_key", "no_source"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def drawn(id_col: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on nothing but the row's id and text."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), digest).cast("binary"))
    return F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def sized(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    carry: str | None = None,
) -> DataFrame:
    """(id, source_key, no_source, size, draw, carried): what the mix must know of each document."""
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(source, F.lit("")).alias("source_key"),
        source.isNull().alias("no_source"),
        n_words(F.col(text_col)).alias("size"),
        drawn(F.col(id_col), F.col(text_col), seed).alias("draw"),
        *([F.col(carry).alias("carried")] if carry else []),
    )


def _ranked(sources: DataFrame) -> DataFrame:
    """The sources with their place in code point order, none last, at any number of them:
    places inside the parts of a sorted table, and one count carried for each part."""
    order = [F.asc("no_source"), F.asc("source_key")]
    row = F.monotonically_increasing_id()
    cut = stored(
        sources.orderBy(*order).withColumns(
            {"part": F.shiftright(row, 33), "row_in_part": row.bitwiseAND((1 << 33) - 1)}
        ),
        "sources",
    )
    starts = (
        cut.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", before(F.col("n"), [], "part").alias("start_at"))
    )
    return cut.join(starts, "part").withColumn("place", F.col("start_at") + F.col("row_in_part"))


def source_targets(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source_key, no_source, n_docs, source_size, target) of each source.

    Sources share ``share`` times all words by weight, the weights repeating in the sources'
    order. A target stops at ``most`` times its source's words; what is over goes to the
    others by weight, until none is above. If all stop, the rest stays unspent.

    One level w * level serves all sources below their limit, and it only rises: each round
    adds up, in one aggregate over the sources, the words of those that the last level fills.
    """
    sources = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    weight = lookup((F.col("place") % len(weights)).cast("int"), list(weights))
    table = stored(_ranked(sources).select(*_KEYS, "n_docs", "source_size", weight.alias("weight")), "weights")
    limit = F.col("source_size").cast("double") * float(most)
    level, filled = 0.0, None
    while True:
        full = limit < F.lit(level) * F.col("weight")
        now = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all_words"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full_words"),
            F.count_if(full).alias("n_full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if now["n_full"] == filled or not now["weight"]:
            break
        filled = now["n_full"]
        level = (share * now["all_words"] - most * now["full_words"]) / now["weight"]
    open_target = F.lit(level) * F.col("weight")
    target = F.when(limit < open_target, limit).otherwise(open_target)
    return table.select(*_KEYS, "n_docs", "source_size", target.alias("target"))


def planned(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with their source's size and target and their own number of copies.

    A source that holds a third of all rows does not gather them: its totals go to its rows.
    """
    joined = join_totals(rows, targets, _KEYS, "n_docs", F.xxhash64("id", "draw"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    with_rate = joined.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    more = (F.col("draw") < F.col("rate") - F.col("whole")).cast("long")
    return with_rate.withColumn("copies", F.col("whole") + more).drop("whole")


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: each row of docs as often as its copies, numbered from 1 in ``copy``.

    A null or empty text has size 0 and weighs nothing; a source without words has target 0
    and gives nothing. Null sources are one source, the last. Rows with the same id and text
    share their draw, others draw apart; the draw depends on nothing else, so reruns agree
    and new documents change others' copies only through the rates. Texts of any length are
    counted whole, inside one row. An empty table gives no row. Other columns are carried
    along, whatever their names; a column named ``copy`` is replaced.
    """
    whole = docs.select(id_col, text_col, source_col, F.struct(*docs.columns).alias("mix_row"))
    narrow = stored(sized(whole, id_col, text_col, source_col, seed), "sizes")
    rows = sized(whole, id_col, text_col, source_col, seed, carry="mix_row")
    plan = planned(rows, source_targets(narrow, weights, share, most)).where("copies > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    kept = [c for c in docs.columns if c != "copy"]
    return plan.select("carried", copy).select(*[F.col("carried")[c].alias(c) for c in kept], "copy")
