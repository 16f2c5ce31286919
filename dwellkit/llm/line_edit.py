"""Near-duplicate lines by a segment-partition edit join.

A line is cut into threshold + 1 segments. Two lines within the threshold share at least
one segment, at a place that the edits on either side of it allow, so each line looks
into the indexes of the lengths that it can reach with those of its substrings. Lines
that share an index entry are compared by a banded bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.buckets import differing, link
from dwellkit.llm.store import numbered, settled, stored
from dwellkit.llm.text import LOWER, as_bytes, mixed, pieces

THRESHOLD = 2
#: Shorter lines have a smaller threshold: two edits would make many of them the same.
MIN_CHARS = 32
#: Lines of so many characters up to ``MIN_CHARS`` may differ by one edit; below that, copies alone count.
SHORT_CHARS = 16
#: Lists of removed lines go to all tasks up to so many, so that texts need not move to meet them.
BROADCAST_ROWS = 200_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANKS = " \t\n\r\x0b\x0c"
_BLANK_BYTES = _BLANKS.encode()
#: A substring's hash is a sum over its characters times powers of this number, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters of lines that are hashed at once.
_AT_ONCE = 1 << 20


def normalised(line: str) -> str:
    """Without blanks at the ends, A-Z in lower case."""
    return line.strip(_BLANKS).translate(_LOWER)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of threshold + 1 segments, the longer ones last."""
    n = threshold + 1
    short, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, indexed: int, threshold: int) -> Iterator[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a line of ``length`` that may match a
    segment of an indexed line that is no longer: edits left of the segment and right of it
    are counted apart, and both must stay within the threshold."""
    shift = length - indexed
    for i, (at, size) in enumerate(segments(indexed, threshold)):
        left, right = i, threshold - i
        lo = max(0, at - left, at + shift - right)
        hi = min(length - size, at + left, at + shift + right)
        for start in range(lo, hi + 1):
            yield i, start, size


def allowed(length: int, threshold: int, min_chars: int, short: bool) -> int:
    """The edits by which a line of at least this length may differ from one of this length."""
    if length >= min_chars:
        return threshold
    return min(1, threshold) if short and length >= min(SHORT_CHARS, min_chars) else 0


def places_of(length: int, threshold: int, min_chars: int, short: bool) -> list[tuple[int, int, int]]:
    """(start, stop, number of the segment) of the substrings that a line of this length looks for."""
    out = []
    for indexed in range(max(SHORT_CHARS if short else min_chars, length - threshold), length + 1):
        own = allowed(indexed, threshold, min_chars, short)
        for i, start, size in probes(length, indexed, own) if length - indexed <= own else ():
            out.append((start, start + size, indexed * (threshold + 1) + i))
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed(lines: list[str], places: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many of each line) of the substrings at these places of lines of one length,
    each hash once a line. Equal hashes of other substrings cost a comparison, no link."""
    if not places:
        return np.empty(0, np.int64), np.zeros(len(lines), np.int64)
    length, (start, stop, seed) = len(lines[0]), np.array(places, np.int64).T
    base, inverse = _powers(_BASE, length), _powers(_INVERSE, length)[start]
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).reshape(len(lines), length)
    sums = np.zeros((len(lines), length + 1), np.uint64)
    np.cumsum(mixed((points + np.uint64(1)) * np.uint64(_BASE)) * base[:-1], axis=1, out=sums[:, 1:])
    keys = mixed(mixed((sums[:, stop] - sums[:, start]) * inverse) + seed.astype(np.uint64) * np.uint64(_BASE))
    keys.sort(axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys[first].view(np.int64), first.sum(axis=1)


def keys_of(line: str, threshold: int, min_chars: int, short: bool = False) -> list[int]:
    """Hashes of the line's own index entries and of those it looks for."""
    # Equal lengths probe their own segments too, so the index entries are among these.
    return hashed([line], places_of(len(line), threshold, min_chars, short))[0].tolist()


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most the threshold.

    Bit d of ``reach[e]`` says that what was read of a matches b up to the same place plus
    d - threshold with at most e edits; a step reads one character for all diagonals.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    if a == b:
        return True
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= threshold
    # The places of each character of b, shifted so that diagonals start at bit 0.
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (i + threshold)
    band = (1 << (2 * threshold + 1)) - 1
    reach = [(1 << threshold) * ((1 << (e + 1)) - 1) & band for e in range(threshold + 1)]
    for j, c in enumerate(a):
        same = places.get(c, 0) >> j & band
        now = [reach[0] & same]
        for e in range(1, threshold + 1):
            now.append((reach[e] & same | reach[e - 1] | reach[e - 1] >> 1 | now[e - 1] << 1) & band)
        reach = now
        if not reach[-1]:
            return False
    return bool(reach[-1] >> (len(b) - len(a) + threshold) & 1)


#: Cells in which a line's characters and its pairs of neighbours are counted modulo 2.
CHAR_CELLS, PAIR_CELLS = 64, 256


def line_sketch(line: str) -> np.ndarray:
    """Whether each cell has an odd number of the line's characters or pairs, 64 cells to a
    number. An edit changes two characters and four pairs at most."""
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    chars = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    pairs = ((points[:-1] << np.uint64(21) | points[1:]) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(56)
    odd = [np.bincount(x.astype(np.int64), minlength=n) & 1 for x, n in ((chars, CHAR_CELLS), (pairs, PAIR_CELLS))]
    return np.packbits(np.concatenate(odd).astype(np.uint8)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [line_sketch(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(rows, pa.list_(pa.int64()))], names=["node", "sketch"]
        )


def _verifier(threshold: int, min_chars: int, short: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            most = [allowed(min(len(s), len(t)), threshold, min_chars, short) for s, t in zip(x, y)]
            found = [i for i in range(len(a)) if within(x[i], y[i], most[i])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[i] for i in found], pa.int64()) for c in (a, b)], names=["a", "b"]
            )

    return run


def _lines(min_chars: int, with_text: bool) -> Callable:
    """A row for each line that is long enough: where it is, or what it says and how often in a few MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20, column="text"):
            at, numbers, digests, texts = [], [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                # What ``normalised`` does, on the bytes of the whole text.
                for number, raw in enumerate((text or b"").translate(LOWER).split(b"\n")):
                    line = raw.strip(_BLANK_BYTES)
                    if len(line) >= min_chars and (min_chars <= 1 or len(line.decode()) >= min_chars):
                        at.append(i)
                        numbers.append(number)
                        digests.append(hashlib.blake2b(line, digest_size=16).digest())
                        texts.append(line)
            digest = pa.array(digests, pa.binary())
            if with_text:
                counts = Counter(digests)
                text = pa.array(dict(zip(digests, texts)).values(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(counts, pa.binary()), text, pa.array(counts.values(), pa.int64())], names=["digest", "text", "n"]
                )
            else:
                ids = batch.column("row_key").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64()), digest], names=["row_key", "line_no", "digest"])

    return run


def _entries(threshold: int, min_chars: int, short: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, list[tuple[int, int, int]]] = {}  # by length, of which lines have few
        out: list[pa.RecordBatch] = []
        for batch in batches:
            lines, nodes = batch.column("text").to_pylist(), np.asarray(batch.column("node"), np.int64)
            sizes = np.fromiter(map(len, lines), np.int64, len(lines))
            order = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.diff(sizes[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                length = int(sizes[own[0]])
                if length not in places:
                    places[length] = places_of(length, threshold, min_chars, short)
                step = max(1, _AT_ONCE // max(1, length))
                for some in (own[i : i + step] for i in range(0, len(own), step)):
                    key, counts = hashed([lines[i] for i in some], places[length])
                    columns = key, np.repeat(nodes[some], counts), np.full(len(key), length)
                    out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "size"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()

    return run


def repeated_lines(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
    short: bool = False,
) -> DataFrame:
    """(key, line_no) of each line to remove.

    Lines of at least ``min_chars`` characters are linked where their edit distance is at
    most ``threshold``. With ``short``, so are shorter ones that aren't blank, at the distance that
    ``allowed`` gives the shorter of two. Of the lines that links connect, the first stays: the one of the smallest
    key, and the first in it. line_no counts lines from 0. Null and empty texts have no
    lines; null keys rank last; rows with one key are one after the other.
    """
    least = 1 if short else min_chars
    texts = docs.select(F.col(key_col).alias("row_key"), F.col(text_col).alias("text"))
    key_type = texts.schema["row_key"].dataType.simpleString()
    places = numbered(
        texts.mapInArrow(_lines(least, False), f"row_key {key_type}, line_no long, digest binary"), "lines", "place"
    )
    distinct = numbered(
        # Repeats within a few MB are one row already; to sort the rest by task would combine little.
        texts.mapInArrow(_lines(least, True), "digest binary, text string, n long")
        .repartition("digest")
        .groupBy("digest")
        .agg(F.first("text").alias("text"), F.sum("n").alias("n")),
        "distinct-lines",
        "node",
    )
    entries = distinct.select("node", "text").mapInArrow(
        _entries(threshold, min_chars, short), "key long, node long, size long"
    )
    chars, pairs = CHAR_CELLS // 64, PAIR_CELLS // 64
    compatible = (
        f"abs(size_a - size_b) <= {threshold} and {differing(range(chars))} <= {2 * threshold}"
        f" and {differing(range(chars, chars + pairs))} <= {4 * threshold}"
    )
    labels = link(
        entries,
        distinct.select("node", "text"),
        _verifier(threshold, min_chars, short),
        compatible,
        lambda near: near.select("node", "text").mapInArrow(_sketches, "node long, sketch array<long>"),
    )
    rank = F.struct(F.col("row_key").isNull().alias("no_key"), "row_key", "place", "line_no")
    related = stored(_related(distinct.select("digest", "node", "n"), labels), "related-lines")
    few = related.count() <= BROADCAST_ROWS
    ranked = places.join(F.broadcast(related) if few else related, "digest").select("label", rank.alias("rank"))
    ranked = stored(ranked, "related-places")
    firsts = ranked.groupBy("label").agg(F.min("rank").alias("stays"))
    return (
        ranked.join(firsts, "label")
        .where("rank > stays")
        .select(F.col("rank.row_key").alias(key_col), F.col("rank.line_no").alias("line_no"))
    )


def _related(distinct: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(digest, label) of the lines that come again or are linked; all others stay where they are."""
    if labels is None:
        return distinct.where("n > 1").select("digest", F.col("node").alias("label"))
    ends = labels.union(labels.select("component", "component")).distinct()
    few = labels.count() <= BROADCAST_ROWS // 2
    joined = distinct.join(F.broadcast(ends) if few else ends, "node", "left").where("n > 1 or component is not null")
    return joined.select("digest", F.coalesce("component", "node").alias("label"))


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
    carry: str | None = None,
    short: bool = False,
) -> DataFrame:
    """(id, text, n_lines, removed) for each row of docs: the text without repeated lines.

    See ``repeated_lines``; removed lists the numbers of the lines taken out, and the others
    stay as they were, in order. A null text stays null and has no lines. Repeated rows are
    rows of their own, of which the later loses its lines.
    """
    picked = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    picked += [F.col(carry).alias("carried")] if carry else []
    # The key of a row is its id and, for rows that share one, its number in the stored table.
    rows = numbered(docs.select(*picked), "line-texts")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id").alias("row_key")

    def removed() -> DataFrame:
        gone = repeated_lines(rows.select(key, "text"), "row_key", "text", threshold, min_chars, short)
        return gone.groupBy(F.col("row_key.row_id").alias("row_id")).agg(F.sort_array(F.collect_set("line_no")).alias("removed"))

    lists = settled(docs.sparkSession, removed, "removed-lines")
    size = lists.agg(F.count(F.lit(1)), F.sum(F.size("removed"))).first()
    few = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= 10 * BROADCAST_ROWS
    joined = rows.join(F.broadcast(lists) if few else lists, "row_id", "left").select(
        "doc_id", "text", F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"), *(["carried"] if carry else [])
    )
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "text")
    out = joined.mapInArrow(_without, f"text string, n_lines long{kinds}")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("text").alias(text_col),
        "n_lines",
        "removed",
        *([F.col("carried").alias(carry)] if carry else []),
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, column="text"):
        texts, counts = [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            lines = text.split("\n") if text is not None else []
            gone = set(removed)
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            counts.append(len(lines))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), *(batch.column(n) for n in names)],
            names=["text", "n_lines", *names],
        )
