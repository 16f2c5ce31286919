"""Links between rows that share a bucket, without all pairs of a bucket.

A bucket's smallest row is its first hub. A member meets one hub first, the smallest over all
its buckets. Members that this connects need no more comparisons among themselves. In buckets
that still hold several components the first hub and 8, 64, 512... other members become hubs
and meet those of other components, until each pair of a bucket has been compared or is
connected. A member costs a row for each hub, never a row for each other member. Of the pairs
of two components only those come out of the join whose sketches allow a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.components import components
from dwellkit.llm.store import is_empty, stored

#: Keys are counted in so many cells; a cell that is this many times the mean is heavy.
CELLS, HEAVY, HEAVY_ROWS = 1 << 16, 8, 20_000
#: Numbers of rows with a bucket go to all tasks up to so many (8 bytes each), so that
#: texts need not move to meet them; beyond that both sides are dealt.
BROADCAST_NODES = 1_000_000


def _with_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of keys that several rows have, from rows sorted by key and node: a key's
    first row is its hub. Holds a batch, whatever the size of a key."""
    last: tuple | None = None  # key, node, size of the hub, and whether it has gone out
    for batch in batches:
        key, node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "size"))
        if not len(key):
            continue
        if last is not None:
            key, node, size = (np.concatenate([[np.int64(x)], c]) for x, c in zip(last, (key, node, size)))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(first)
        which = np.cumsum(first) - 1
        sizes = np.diff(np.append(starts, len(key)))
        out = (sizes > 1)[which]
        if last is not None and last[3]:
            out[0] = False  # went out with an earlier batch
        at = starts[-1]
        went = bool(out[at]) or (at == 0 and last is not None and last[3])
        hub = starts[which]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[out], pa.int64()) for c in (key, node, size, node[hub], size[hub])],
            names=["key", "node", "size", "hub", "hub_size"],
        )
        last = (key[at], node[at], size[at], went)


def members_of(entries: DataFrame) -> DataFrame:
    """(key, node, size, hub, hub_size) of the entries (key, node, size) whose key another row has.

    Rows are dealt by key once and read in order. Keys in a cell with far more rows than
    others are counted by grouping first, so that a key which a large part of all rows
    has is combined before it moves, and joined back by a join that Spark can split.
    """
    cell = F.pmod(F.col("key"), F.lit(CELLS))
    counts = entries.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most CELLS rows
    limit = max(HEAVY_ROWS, HEAVY * counts["n"].mean()) if len(counts) else 0
    heavy = [int(c) for c in counts["cell"][counts["n"] > limit]]
    names = "key long, node long, size long, hub long, hub_size long"
    kept = entries if not heavy else entries.where(~cell.isin(heavy))
    out = (
        kept.select("key", "node", "size")
        .repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(_with_hubs, names)
    )
    if heavy:
        rest = entries.where(cell.isin(heavy)).select("key", "node", "size")
        hubs = (
            rest.groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("first"))
            .where("n > 1")
            .select("key", F.col("first.node").alias("hub"), F.col("first.size").alias("hub_size"))
        )
        out = out.union(rest.join(hubs, "key").select("key", "node", "size", "hub", "hub_size"))
    return out


def differing(places: range) -> str:
    """SQL for the number of bits in which two sketches differ at these places."""
    return "(" + " + ".join(f"bit_count(sketch_a[{i}] ^ sketch_b[{i}])" for i in places) + ")"


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """With label, the component of node, or node itself where it has none."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    renamed = labels.select(F.col("node"), F.col("component").alias("found"))
    return members.join(renamed, "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found")


def link(
    entries: DataFrame, texts: DataFrame, verify: Callable, compatible: str, sketches: DataFrame | Callable
) -> DataFrame | None:
    """(node, component) over the nodes that links connect; None where no bucket has two rows.

    entries: (key, node, size), distinct; texts: (node, text); sketches: (node, sketch), a few
    numbers that tell pairs apart, or what makes them of (node, text). ``compatible`` is a SQL condition on size_a,
    size_b, sketch_a and sketch_b that linked pairs fulfil; ``verify`` maps Arrow batches
    (a, b, text_a, text_b), sorted by b, to the linked (a, b).
    """
    members = stored(members_of(entries), "buckets")
    if is_empty(members):
        return None
    nodes = stored(members.select("node").distinct(), "bucket-nodes")
    few = nodes.count() <= BROADCAST_NODES
    near = stored(texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi"), "bucket-texts")

    def links_of(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(near.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(near.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return stored(with_b.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "links")

    if callable(sketches):
        sketches = stored(sketches(near), "sketches")

    def compatible_pairs(pairs: DataFrame) -> DataFrame:
        """Of (a, b, size_a, size_b) those worth a look into the texts."""
        with_a = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        both = with_a.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        return both.where(compatible).select("a", "b")

    own_pair = [F.col("node").alias("a"), F.col("hub").alias("b"), F.col("size").alias("size_a"), F.col("hub_size").alias("size_b")]
    one_each = members.where("node <> hub").groupBy("node", "size").agg(F.min(F.struct("hub", "hub_size")).alias("least"))
    tested = stored(compatible_pairs(one_each.select("node", "size", "least.*").select(*own_pair)), "pairs")
    links = links_of(tested)
    labels = components(links, "a", "b")
    rest, hubs = members.select("key", "node", "size", "hub"), 8
    while True:
        rest = labelled(rest, labels)
        open_keys = (
            rest.groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
            .where("lo <> hi")
            .select("key", "n")
        )
        # Whether a member is a hub follows from its number and the round alone.
        draw = F.pmod(F.xxhash64("node", F.lit(hubs)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        is_hub = (F.col("node") == F.col("hub")) | (draw * F.col("n") < F.lit(float(hubs)))
        held = rest.join(open_keys, "key").withColumn("is_hub", is_hub)
        rest = stored(held if "sketch" in held.columns else held.join(sketches, "node"), "open-buckets")
        if is_empty(rest):
            return labels
        hub_rows = rest.where("is_hub").select(
            "key",
            F.col("node").alias("b"),
            F.col("size").alias("size_b"),
            F.col("sketch").alias("sketch_b"),
            F.col("label").alias("label_b"),
        )
        pairs = (
            rest.select(
                "key",
                F.col("node").alias("a"),
                F.col("size").alias("size_a"),
                F.col("sketch").alias("sketch_a"),
                "label",
                "is_hub",
            )
            .join(hub_rows, "key")
            .where((F.col("label") != F.col("label_b")) & (~F.col("is_hub") | (F.col("a") < F.col("b"))))
            .where(compatible)
            .select("a", "b")
            .distinct()
        )
        done = tested.union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = stored(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(now)
        more = links_of(now)
        if not is_empty(more):
            links = links.union(more)
            labels = components(links, "a", "b")
        rest, hubs = rest.where("not is_hub").select("key", "node", "size", "hub", "sketch"), hubs * 8
