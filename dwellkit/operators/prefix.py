"""Row numbers, running totals and exact ranks that no single hot key can break.

A window over a key puts all rows of that key on one task. When a key may hold a
third of the table that task never ends. Every function here splits the order of a
key into chunks by a fixed, monotone function of the row: rows meet only inside
(key, chunk), and what must be carried from chunk to chunk is one small total per
chunk. The only window over a whole key runs on those totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def join_small(df: DataFrame, small: DataFrame, on, rows: int | None, how: str = "inner") -> DataFrame:
    """Join a side of at most ``rows`` rows: broadcast while that bound is low,
    an ordinary join (sized and skew-split at run time) when it is high or unknown."""
    side = F.broadcast(small) if rows is not None and rows <= BROADCAST_ROWS else small
    return df.join(side, on, how)


HOT_ROWS = 1 << 22


def join_totals(
    df: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    rows: str,
    salt: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join each row with its key's row of ``totals``, where a key may hold any share
    of ``df``.

    ``totals`` is an aggregate by key; its column ``rows`` is the key's number of rows
    in ``df`` and is dropped. (The run-time skew split does not apply to such a join:
    the aggregate sits between its exchange and the join.) Keys of more than
    ``hot_rows`` rows are at most rows / hot_rows in number, so their totals are
    broadcast; their rows leave the key's partition by ``salt`` and find no partner
    there. All other keys join as usual. ``df`` is read and shuffled once.
    """
    keys = list(keys)
    names = [c for c in totals.columns if c not in keys and c != rows]
    found = F.struct(F.lit(True).alias("any"), *names)
    hot = totals.filter(F.col(rows) > hot_rows).select(*keys, found.alias("hot_total"))
    # 0 for every row kept, but not a literal: the optimizer would drop a literal from
    # the join key, and with it the spreading.
    at_home = (F.col(rows) > hot_rows).cast("int").alias("spread")
    cold = totals.filter(F.col(rows) <= hot_rows).select(*keys, at_home, found.alias("cold_total"))
    spread = F.when(F.col("hot_total").isNotNull(), F.pmod(F.xxhash64(salt), F.lit(8192)).cast("int") + 1)
    joined = (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("spread", F.coalesce(spread, F.lit(0)))
        .join(cold, [*keys, "spread"], "left")
        .withColumn("total", F.coalesce("hot_total", "cold_total"))
    )
    if how == "inner":
        joined = joined.filter(F.col("total.any"))
    return joined.select(*df.columns, *[F.col(f"total.{n}").alias(n) for n in names])


def before(col: Column, keys: Sequence[str], order: str) -> Column:
    """Sum over all earlier rows of the key, 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(col).over(w), F.lit(0))


#: Most pieces that one crowded cell is cut into.
RECUTS = 1 << 10


def quantile_cuts(column: str, pieces: int) -> Column:
    """The values that cut a column into so many pieces of about equal rows, from a sketch
    that is right to a tenth of a piece. As text: thousands of literals would be sent one by
    one to the JVM."""
    grid = ", ".join(f"{i / pieces!r}D" for i in range(1, pieces))
    return F.expr(f"percentile_approx({column}, array({grid}), {10 * pieces})")


def cuts_below(cuts: Column, value: Column, most: int) -> Column:
    """How many of fewer than ``most`` (a power of two) ascending cuts are at most the value,
    by halving; past the last cut there is no number."""
    halves = F.array(*[F.lit(most >> k) for k in range(1, most.bit_length())])
    return F.aggregate(
        halves, F.lit(0), lambda at, h: at + F.when(F.get(cuts, at + h - 1) <= value, h).otherwise(0)
    )


def recut(df: DataFrame, cell: Sequence[str], value: Column, part: str, part_rows: int, among: Column | None = None) -> DataFrame:
    """Make ``part`` finer where more than ``part_rows`` rows share a cell.

    A cell is its columns ``cell``, ``part`` among them. A crowded one is cut at its own
    quantiles, which come from a mergeable sketch, so however its values crowd, a piece holds
    about half of ``part_rows`` (or 1/1024 of the cell, where that is more). Only equal values
    stay together. Which piece a row is in is decided by comparing it with the cuts, so counts
    per piece are exact and pieces are in order: the new part is part * 1024 + piece. Crowded
    cells are at most rows / part_rows in number; their lists of cuts are broadcast, and rows
    of other cells pay for a join that finds nothing. Cells are counted where ``among`` holds.
    """
    cell = list(cell)
    counted = df if among is None else df.filter(among)
    crowded = counted.groupBy(*cell).agg(F.count(F.lit(1)).alias("cell_rows")).filter(F.col("cell_rows") > part_rows)
    pieces = F.least(F.lit(float(RECUTS)), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("cell_rows") * 2 / part_rows))))
    cuts = (
        counted.select(*cell, value.alias("cut_value"))
        .join(F.broadcast(crowded), cell)
        .groupBy(*cell, "cell_rows")
        .agg(quantile_cuts("cut_value", RECUTS).alias("quantiles"))
        .withColumn("every", (F.lit(RECUTS) / pieces).cast("int"))
        .select(*cell, F.filter("quantiles", lambda x, i: (i + 1) % F.col("every") == 0).alias("cuts"))
    )
    piece = F.when(F.col("cuts").isNotNull(), cuts_below(F.col("cuts"), F.col("cut_value"), RECUTS)).otherwise(F.lit(0))
    return (
        df.withColumn("cut_value", value)
        .join(F.broadcast(cuts), cell, "left")
        .withColumn(part, F.col(part).cast("long") * RECUTS + piece)
        .select(*df.columns)
    )


def index_rows(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    scale: Column,
    hot_rows: int = 1 << 21,
    index: str = "sample_idx",
    chunk: str = "chunk",
) -> DataFrame:
    """Add ``index`` (0-based position in the key's order) and ``chunk``.

    ``scale`` is a number that never falls along ``order_by``. Keys of at most
    ``hot_rows`` rows stay in chunk 0; a larger one is cut into 16 * rows / hot_rows
    equal stretches of its own scale, and a stretch that a burst fills with more than
    ``hot_rows`` rows once more, by ``recut``. There
    are at most (table rows / hot_rows) such keys, so their list is small enough to
    broadcast whatever the table's size: a table of 10^12 rows has at most 4.8e5.
    """
    scale = scale.cast("double")
    hot = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(scale).alias("scale_lo"), F.max(scale).alias("scale_hi"))
        .filter(F.col("n_rows") > hot_rows)
        .select(key, "scale_lo", "scale_hi", F.ceil(F.col("n_rows") * 16 / hot_rows).alias("n_parts"))
    )
    is_hot = F.col("n_parts").isNotNull()
    place = F.try_divide(scale - F.col("scale_lo"), F.col("scale_hi") - F.col("scale_lo"))
    part = F.coalesce(F.floor(place * F.col("n_parts")), F.lit(0)).cast("long")
    cut = (
        df.join(F.broadcast(hot), key, "left")
        .withColumn(chunk, F.when(is_hot, part).otherwise(F.lit(0).cast("long")))
        .drop("scale_lo", "scale_hi")
    )
    cut = recut(cut, [key, chunk], scale, chunk, hot_rows, among=is_hot)
    offsets = (
        cut.filter(is_hot)
        .groupBy(key, chunk)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("start_at", before(F.col("n_rows"), [key], chunk))
        .select(key, chunk, "start_at")
    )
    local = Window.partitionBy(key, chunk).orderBy(*order_by)
    return (
        cut.drop("n_parts")
        .withColumn("row_in_chunk", F.row_number().over(local))
        .join(offsets, [key, chunk], "left")
        .withColumn(index, F.coalesce("start_at", F.lit(0).cast("long")) + F.col("row_in_chunk") - 1)
        .drop("row_in_chunk", "start_at")
    )


def hash_key(*cols: Column | str, seed: str = "") -> Column:
    """Order key that depends on nothing but the row's id: md5 of the id as text."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(seed)) if seed else F.concat_ws(
        ":", *[p.cast("string") for p in parts]
    )
    return F.md5(text.cast("binary"))


HASH_DIGITS = 4


def hash_chunk(hash_col: Column) -> Column:
    """Leading hex digits of a hash as a number: 65,536 even, ordered chunks."""
    return F.conv(F.substring(hash_col, 1, HASH_DIGITS), 16, 10).cast("long")


def number_by_hash(df: DataFrame, hash_col: str, tie: Sequence[str], name: str) -> DataFrame:
    """Global 1-based row number in hash order, without a one-partition window.

    The hash spreads rows evenly over 65,536 chunks; one count per chunk is carried.
    """
    cut = df.withColumn("hash_part", hash_chunk(F.col(hash_col)))
    offsets = (
        cut.groupBy("hash_part")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("start_at", before(F.col("n_rows"), [], "hash_part"))
        .select("hash_part", "start_at")
    )
    local = Window.partitionBy("hash_part").orderBy(hash_col, *tie)
    numbered = cut.withColumn("row_in_part", F.row_number().over(local))
    return (
        join_small(numbered, offsets, "hash_part", rows=16**HASH_DIGITS)
        .withColumn(name, F.col("start_at") + F.col("row_in_part"))
        .drop("hash_part", "row_in_part", "start_at")
    )


def mark_first_by_hash(
    df: DataFrame,
    group: str,
    hash_col: str,
    tie: Sequence[str],
    quota: DataFrame,
    n_groups: int | None,
    flag: str,
) -> DataFrame:
    """Flag the first ``quota_rows`` rows of every group in hash order, exactly.

    The rows themselves are never shuffled or sorted. Pass 1 counts rows per
    (group, hash chunk) and finds the chunk in which the quota is used up. Pass 2
    ranks only the rows of that chunk (1/65,536 of a group) and reads off the last row
    inside the quota. Pass 3 compares each row with that bound. ``quota`` is
    (group, quota_rows); ``n_groups`` bounds its rows. Groups without a quota get
    no flag.
    """
    key = [hash_col, *tie]
    cut = df.select(group, *key).withColumn("hash_part", hash_chunk(F.col(hash_col)))
    filled = (
        cut.groupBy(group, "hash_part")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("taken", before(F.col("n_rows"), [group], "hash_part"))
    )
    last_part = (
        join_small(filled, quota, group, n_groups)
        .filter((F.col("taken") < F.col("quota_rows")) & (F.col("taken") + F.col("n_rows") >= F.col("quota_rows")))
        .select(group, "hash_part", (F.col("quota_rows") - F.col("taken")).alias("still"))
    )
    local = Window.partitionBy(group, "hash_part").orderBy(*key)
    bound = (
        join_small(cut, last_part, [group, "hash_part"], n_groups)
        .withColumn("rank_in_part", F.row_number().over(local))
        .filter(F.col("rank_in_part") == F.col("still"))
        .select(group, F.struct(*key).alias("bound"))
    )
    sizes = filled.groupBy(group).agg(F.sum("n_rows").alias("n_all"))
    limits = (
        quota.join(sizes, group)
        .join(bound, group, "left")
        .select(group, "n_all", "bound", (F.col("quota_rows") >= F.col("n_all")).alias("take_all"))
    )
    if n_groups is None:
        marked = join_totals(df, limits, [group], "n_all", F.col(hash_col), "left")
    else:
        marked = join_small(df, limits.drop("n_all"), group, n_groups, "left")
    inside = F.coalesce(F.col("take_all") | (F.struct(*key) <= F.col("bound")), F.lit(False))
    return marked.withColumn(flag, inside).drop("bound", "take_all")


def with_value_part(df: DataFrame, x: str, lo: str, hi: str, steps: int, out: str = "value_part") -> DataFrame:
    """Ordered parts of [lo, hi] that get finer toward both ends.

    Each halving of the distance to the nearer end is a stretch of ``steps`` equal
    parts, down to 2^-60 of the range. One far outlier, or scores that crowd against 1,
    thus do not push all other values into one part. At most 2 * 61 * steps parts.
    Intermediate columns keep each step from being evaluated once per use.
    """
    value, low, high = (F.col(c).cast("double") for c in (x, lo, hi))
    near = F.least("from_lo", "from_hi")
    halvings = F.when(F.col("near") > 0, F.least(F.floor(-F.log2("near")), F.lit(60))).otherwise(F.lit(60))
    within = F.floor((F.col("near") * F.pow(F.lit(2.0), F.col("halvings")) - 0.5) * 2 * steps)
    step = (F.lit(60) - F.col("halvings")) * steps + F.greatest(F.least(within, F.lit(steps - 1)), F.lit(0))
    part = F.when(F.col("from_lo") <= F.col("from_hi"), F.col("step")).otherwise(F.lit(2 * 61 * steps) - F.col("step"))
    return (
        df.withColumns({"value_lo": low, "value_width": high - low})
        .withColumns(
            {
                "from_lo": F.when(F.col("value_width") > 0, (value - F.col("value_lo")) / F.col("value_width")),
                "from_hi": F.when(F.col("value_width") > 0, (high - value) / F.col("value_width")),
            }
        )
        .withColumn("near", near)
        .withColumn("halvings", halvings)
        .withColumn("step", step)
        .withColumn(out, F.when(F.col("value_width") > 0, part).otherwise(F.lit(0)).cast("long"))
        .drop("value_lo", "value_width", "from_lo", "from_hi", "near", "halvings", "step")
    )


def value_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Sequence[str],
    n_keys: int | None = None,
    steps: int = 1 << 14,
    descending: bool = False,
    part_rows: int = 1 << 20,
    pieces: int = 1 << 10,
) -> DataFrame:
    """Running sums of ``weights`` along ``value`` for every distinct value.

    ``df`` holds one row per (keys, value), so a value carried by a third of the
    input is one row here. Without keys, the order is cut at ``pieces`` quantiles of a sketch
    that rides on the totals' aggregate, so values may crowd anywhere. The order of a key is
    cut by ``with_value_part``, and where values crowd inside its range by ``recut``. Sums over
    earlier parts are carried. Adds ``cum_<w>`` (including
    the row's own) and ``all_<w>`` (the key's total) for every weight. ``n_keys``
    bounds the number of distinct keys.
    """
    keys = list(keys)
    sums = [F.sum(w).alias(f"all_{w}") for w in weights]
    ends = [F.min(value).alias("lo"), F.max(value).alias("hi")]
    if not keys:
        number = F.col(value).cast("double")
        span = df.withColumn("cut_value", number).agg(quantile_cuts("cut_value", pieces).alias("cuts"), *sums)
        held = df.withColumn("span", span.select(F.struct(*span.columns)).scalar())
        below = cuts_below(F.col("span.cuts"), number, pieces)
        cut = held.select(
            *df.columns, *[F.col(f"span.all_{w}").alias(f"all_{w}") for w in weights], below.cast("long").alias("value_part")
        )
        return _summed(cut, keys, value, weights, descending)
    span = df.groupBy(*keys).agg(*ends, *sums)
    if n_keys is None:
        counts = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_values"), *ends, *sums
        )
        ranged = join_totals(df, counts, keys, "n_values", F.col(value))
    else:
        ranged = join_small(df, span, keys, n_keys)
    cut = with_value_part(ranged, value, "lo", "hi", steps).drop("lo", "hi")
    cut = recut(cut, [*keys, "value_part"], F.col(value), "value_part", part_rows)
    return _summed(cut, keys, value, weights, descending)


def _summed(cut: DataFrame, keys: list[str], value: str, weights: Sequence[str], descending: bool) -> DataFrame:
    """Running sums inside each part, plus what the parts before it hold."""
    if descending:
        cut = cut.withColumn("value_part", -F.col("value_part"))
    carried = cut.groupBy(*keys, "value_part").agg(*[F.sum(w).alias(f"part_{w}") for w in weights])
    carried = carried.select(
        *keys, "value_part", *[before(F.col(f"part_{w}"), keys, "value_part").alias(f"pre_{w}") for w in weights]
    )
    direction = F.desc(value) if descending else F.asc(value)
    local = (
        Window.partitionBy(*keys, "value_part")
        .orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = cut.select("*", *[F.sum(w).over(local).alias(f"own_{w}") for w in weights])
    out = out.join(carried, [*keys, "value_part"])
    out = out.select("*", *[(F.col(f"pre_{w}") + F.col(f"own_{w}")).alias(f"cum_{w}") for w in weights])
    return out.drop("value_part", *[f"own_{w}" for w in weights], *[f"pre_{w}" for w in weights])
