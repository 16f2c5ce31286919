"""Benchmark decontamination by winnowing.

Of every window of consecutive word k-grams the smallest hash is kept. Two texts that
share ``k + window - 1`` words in a row keep at least one hash in common, so with k = 5
and 6 k-grams to a window no shared span of 10 words is missed. Common hashes say how
the texts lie against each other; along that diagonal the words are compared and shared
spans extended to their full length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.store import numbered, stored
from dwellkit.llm.text import LOWER_ALNUM, WordHashes, as_bytes, grams, mixed, pieces

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
#: Bits of the map that tells which hashes the benchmark has. Its size is fixed: a larger
#: benchmark lets more hashes through to the join, and changes nothing else.
MAP_BITS = 22


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Places of the kept k-grams: the last smallest of each window, of all where they are fewer."""
    h = grams(hashes, K)
    if len(h) <= WINDOW:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))] if len(h) else [], np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    last = WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1)
    return np.unique(np.arange(len(windows)) + last)


def _tagged(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of whole items of n words are told apart from k-grams and other lengths."""
    return mixed(h ^ np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_ALNUM).split()


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        out: list[tuple] = []
        for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text"))):
            h = hashes.of(_words(text))
            if len(h) >= SPAN:
                at = fingerprints(h)
                keys = _tagged(grams(h, K)[at], 0)
                out += [(item, 0, int(p), int(k)) for p, k in zip(at, keys)]
            elif len(h):
                out.append((item, len(h), 0, int(_tagged(grams(h, len(h)), len(h))[0])))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            names=["item", "short", "item_at", "key"],
        )


def _scanner(bits: bytes, lengths: list[int]) -> Callable:
    """Words of each text and those of its hashes that the map has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool), WordHashes()
        for batch in pieces(batches, column="text"):
            counts, found, texts = [], [], []
            for text in as_bytes(batch.column("text")):
                h = hashes.of(_words(text))
                at = fingerprints(h)
                sets = [(at, _tagged(grams(h, K)[at], 0))]
                for n in lengths:
                    keys = _tagged(grams(h, n), n)
                    sets.append((np.arange(len(keys)), keys))
                hits = []
                for places, keys in sets:
                    keep = known[keys & ((1 << MAP_BITS) - 1)]
                    hits += [{"at": int(p), "key": int(k)} for p, k in zip(places[keep], keys[keep])]
                counts.append(len(h))
                found.append(hits or None)
                texts.append(text if hits else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *(c for c, name in zip(batch.columns, batch.schema.names) if name != "text"),
                    pa.array(counts, pa.int64()),
                    pa.array(found, pa.list_(pa.struct([("at", pa.int64()), ("key", pa.int64())]))),
                    pa.array(texts, pa.binary()),
                ],
                names=[*(name for name in batch.schema.names if name != "text"), "n_words", "hits", "hit_text"],
            )

    return run


def shared_spans(doc: np.ndarray, item: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """Runs of at least so many equal words where item word i lies on document word i + shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < least:
        return []
    equal = np.concatenate([[False], item[lo:hi] == doc[lo + shift : hi + shift], [False]])
    edges = np.flatnonzero(equal[1:] != equal[:-1])
    return [(int(a) + lo + shift, int(b) + lo + shift) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, last, doc = WordHashes(), None, None
    span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
    for batch in batches:
        rows, items, shifts = (batch.column(c).to_pylist() for c in ("row_id", "item", "shifts"))
        texts, item_texts = batch.column("hit_text"), as_bytes(batch.column("item_text"))
        out: tuple[list, list, list] = ([], [], [])
        for i, row in enumerate(rows):
            if row != last:
                last, doc = row, hashes.of(_words(texts[i].as_py()))
            item = hashes.of(_words(item_texts[i]))
            spans = sorted({s for x in shifts[i] for s in shared_spans(doc, item, x, min(SPAN, len(item)))})
            if spans:
                for column, value in zip(out, (row, items[i], [{"lo": a, "hi": b} for a, b in spans])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(span))],
            names=["row_id", "item", "spans"],
        )


def _bitmap(prints: DataFrame) -> bytes:
    """At most 2^MAP_BITS numbers come to the driver, whatever the benchmark's size."""
    cells = prints.select(F.col("key").bitwiseAND((1 << MAP_BITS) - 1).alias("cell")).distinct().toPandas()["cell"]
    known = np.zeros(1 << MAP_BITS, bool)
    known[cells.to_numpy(np.int64)] = True
    return np.packbits(known).tobytes()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: str | None = None,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of docs.

    A window is ten consecutive words of an item, or all words of a shorter one. n_hit:
    the document's words inside any occurrence of a window; spans: where they lie, in
    words, of one item each and so perhaps overlapping; n_items: ids of items whose
    windows occur, and items_sha256 the digest of those ids, sorted as strings and joined
    by commas. An empty or null text has no words and no hit. Repeated rows are rows of
    their own; items with one id count once, an item without an id marks words but isn't
    counted. An empty benchmark hits nothing. Only the named columns are read.
    """
    items = numbered(benchmark.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text")), "items", "item")
    prints = stored(
        items.select("item", "text").mapInArrow(_item_prints, "item long, short int, item_at long, key long"), "prints"
    )
    lengths = sorted(r[0] for r in prints.where("short > 0").select("short").distinct().collect())
    picked = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    picked += [F.col(carry).alias("carried")] if carry else []
    narrow = docs.select(*picked)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in narrow.schema if f.name != "text")
    scanned = numbered(
        narrow.mapInArrow(
            _scanner(_bitmap(prints), lengths),
            f"{kinds}n_words long, hits array<struct<at: long, key: long>>, hit_text binary",
        ),
        "scanned",
    )
    near = scanned.where("hits is not null")
    shifts = (
        near.select("row_id", F.explode("hits").alias("hit"))
        .select("row_id", "hit.at", "hit.key")
        .join(prints.select("key", "item", "item_at"), "key")
        .groupBy("row_id", "item")
        .agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    )
    found = (
        shifts.join(items.select("item", F.col("text").alias("item_text")), "item")
        .join(near.select("row_id", "hit_text"), "row_id")
        .select("row_id", "item", "shifts", "hit_text", "item_text")
        .mapInArrow(_extend, "row_id long, item long, spans array<struct<lo: long, hi: long>>")
        .join(items.select("item", F.col("name").cast("string").alias("name")), "item")
        .groupBy("row_id")
        .agg(
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.collect_set("name")).alias("names"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["hi"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(acc["end"], s["lo"]))).alias("n"),
        ),
    )["n"]
    n_hit = F.coalesce(covered, F.lit(0))
    # Only rows with a hash of the benchmark can have a span; the others don't move to meet those found.
    kinds = {f.name: f.dataType for f in found.schema}
    free = scanned.where("hits is null").drop("hits", "hit_text").select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("spans", "names")))
    held = near.drop("hits", "hit_text").join(found, "row_id", "left")
    return free.unionByName(held).select(
        F.col("doc_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "names"), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
        *([F.col("carried").alias(carry)] if carry else []),
    )
