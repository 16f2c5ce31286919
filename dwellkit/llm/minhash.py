"""Near-duplicate documents by circulant MinHash.

One permutation scatters a document's shingles over a ring of cells, a second one gives
every cell a rank. Coordinate k of a signature is the smallest rank among the document's
cells shifted by k, so two permutations give any number of coordinates, and the
coordinates of one shingle lie side by side in memory. Bands of coordinates make
buckets; documents that share a bucket are compared on their full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.buckets import differing, labelled, link
from dwellkit.llm.store import numbered, settled, stored
from dwellkit.llm.text import LOWER, WordHashes, as_bytes, pieces, shingle_set

RING_BITS = 22
#: 64 bands of 8 coordinates: a pair at 0.8 shares no bucket with probability 8e-6, one at
#: 0.3 shares one with probability 0.004.
BANDS, ROWS = 64, 8
#: Lowest bits of the 512 coordinates that a compared pair may differ in. A pair at 0.8
#: differs in 51 on average and in more than 96 with probability 1e-10; one at 0.5 in 128.
MOST_BITS = 96
#: Cells in which a set's shingles are counted modulo 2. Sets that differ in d shingles differ in d cells at most.
PARITY_BITS = 512
#: Rows that share a component go to all tasks up to so many, so that texts need not move to meet them.
BROADCAST_ROWS = 200_000


def ring(bands: int = BANDS, rows: int = ROWS, seed: int = 20) -> np.ndarray:
    """Ranks of each cell and of the cells after it, once around."""
    ranks = np.random.default_rng(seed).permutation(1 << RING_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: bands * rows - 1]]), bands * rows)


def signature(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    cells = ((shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - RING_BITS)).astype(np.int64)
    out = np.full(ranks.shape[1], 0xFFFFFFFF, np.uint32)
    for start in range(0, len(cells), 1024):
        np.minimum(out, ranks[cells[start : start + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    table = sig.reshape(bands, -1).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in table.T:
        h = (h ^ (h >> np.uint64(29)) ^ column) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, 64 to a number."""
    return np.packbits((sig & 1).astype(np.uint8)).view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether each cell has an odd number of the shingles, 64 cells to a number."""
    shift = np.uint64(64 - (PARITY_BITS.bit_length() - 1))
    cells = ((shingles * np.uint64(0x9FB21C651E98DF25)) >> shift).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def _signer(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = WordHashes(), ring()
        for batch in pieces(batches, column="text"):
            sizes, digests, keys, sketches = [], [], [], []
            for text in as_bytes(batch.column("text")):
                s = shingle_set(hashes.of((text or b"").translate(LOWER).split()), words)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s, ranks) if len(s) else None
                keys.append(None if sig is None else band_keys(sig))
                sketches.append(None if sig is None else np.concatenate([sketch(sig), parity(s)]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=[*batch.schema.names, "n_shingles", "digest", "keys", "sketch"],
            )

    return run


def _verifier(words: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, hub = WordHashes(), None, None
        for batch in batches:
            a, b, found = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            texts_a, texts_b = batch.column("text_a"), batch.column("text_b")
            for i in range(len(a)):
                if b[i] != last:
                    last = b[i]
                    hub = shingle_set(hashes.of(as_bytes(texts_b.slice(i, 1))[0].translate(LOWER).split()), words)
                own = shingle_set(hashes.of(as_bytes(texts_a.slice(i, 1))[0].translate(LOWER).split()), words)
                both = np.intersect1d(own, hub, assume_unique=True).size
                if 100 * both >= percent * (len(own) + len(hub) - both):
                    found.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for i in found], pa.int64()) for x in (a, b)], names=["a", "b"]
            )

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    carry: str | None = None,
    with_text: bool = False,
) -> DataFrame:
    """(id, n_shingles, component_id, kept, first) for each row of docs.

    Rows are linked where the Jaccard similarity of their sets of word shingles is at
    least ``percent`` hundredths; component_id is the smallest id that links lead to.
    Rows without a word are linked with nothing. kept: the row's id is component_id.
    first: the row is the one to keep of its component; of repeated rows with one id it
    is one alone. ``carry`` names a column to pass through, ``with_text`` passes the text. A null text is empty; a row
    with a null id is in its component but never names it, and is kept only as the first
    of a component without ids, whose component_id is null. Only the named columns are
    read, so others may have any name; no rows give no rows.
    """
    picked = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    picked += [F.col(carry).alias("carried")] if carry else []
    narrow = docs.select(*picked)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema)
    signed = numbered(
        narrow.mapInArrow(
            _signer(words), f"{kinds}, n_shingles long, digest binary, keys array<long>, sketch array<long>"
        ),
        "signed",
    )
    together = settled(docs.sparkSession, lambda: _together(signed, words, percent), "together")
    few = together.count() <= BROADCAST_ROWS
    passed = [*(["carried"] if carry else []), *(["text"] if with_text else [])]
    own = signed.select("row_id", "doc_id", "n_shingles", *passed)
    out = own.join(F.broadcast(together) if few else together, "row_id", "left")
    is_first = F.coalesce("is_first", F.lit(True))
    component = F.when(F.col("is_first").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, is_first & component.isNull()).alias("kept"),
        is_first.alias("first"),
        *([F.col("carried").alias(carry)] if carry else []),
        *([F.col("text").alias(text_col)] if with_text else []),
    )


def _together(signed: DataFrame, words: int, percent: int) -> DataFrame:
    """(row_id, component_id, is_first) of the rows whose component has other rows."""
    # Rows with equal sets are one class; its node is one row's number.
    classes = stored(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("row_id").alias("node"),
            F.min("doc_id").alias("least_id"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first_row"),
            F.first("n_shingles").alias("size"),
            F.first("keys").alias("keys"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    texts = signed.select(F.col("row_id").alias("node"), "text")
    entries = classes.select("node", "size", F.explode("keys").alias("key"))
    # Sets of very different size can't be that similar, nor those whose signatures differ in very many bits.
    compatible = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    if percent >= 80:
        compatible += f" and {differing(range(BANDS * ROWS // 64))} <= {MOST_BITS}"
    # At similarity p sets of a and b shingles differ in (a + b) * (1 - p) / (1 + p) of them at most: no linked pair is lost.
    cells = differing(range(BANDS * ROWS // 64, (BANDS * ROWS + PARITY_BITS) // 64))
    compatible += f" and {100 + percent} * {cells} <= {100 - percent} * (size_a + size_b)"
    labels = link(entries, texts, _verifier(words, percent), compatible, classes.select("node", "sketch"))
    named = labelled(classes.select("digest", "n", "node", "least_id", "first_row"), labels)
    roots = (
        named.groupBy("label")
        .agg(F.min("least_id").alias("component_id"), F.min("first_row").alias("first_row"), F.sum("n").alias("all"))
        .where("all > 1")
    )
    by_set = named.select("digest", "label").join(roots, "label").select("digest", "component_id", "first_row.row_id")
    is_first = F.col("row_id") == F.col("first_id")
    rows = signed.select("row_id", "digest").join(by_set.withColumnRenamed("row_id", "first_id"), "digest")
    return rows.select("row_id", "component_id", is_first.alias("is_first"))
