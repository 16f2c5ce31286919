"""Token-id files compressed by Re-Pair grammars, with access to any document.

A shard is a stretch of documents in id order. Within it the most frequent pairs of
neighbouring ids are replaced by new symbols, again and again; the shard keeps the pairs,
how long each symbol is when expanded, the remaining sequence, and where each document
begins in it. A document is expanded without its neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dwellkit.llm.pretokens import Splitter, distinct, encoded, gathered, grown, packed, shrunk
from dwellkit.llm.store import stored
from dwellkit.llm.text import pieces

#: Ids of a shard, but for a longer document, which is a shard by itself.
#: Characters of a text that tell rows of one id apart where the table is cut into parts.
KEY_CHARS = 32
SHARD_IDS = 1_000_000
#: Words whose ids a task remembers beside those of its open shard.
KNOWN_WORDS = 400_000
#: A pair is replaced while it stands this often; rounds end when a round would shorten the shard by less than this share.
LEAST, WORTH = 8, 0.01
#: Sequences end documents; a symbol never reaches over one.
END_OF_DOC = -1


def _chosen(counts: np.ndarray) -> np.ndarray:
    """Places of pairs to replace: each is counted at least as often as the pairs that overlap
    it; of equal ones in a row every other one. counts: of the pair at each place."""
    n = len(counts)
    start = np.ones(n, bool)
    start[1:] = counts[1:] != counts[:-1]
    heads = np.flatnonzero(start)
    # Runs of equal counts; one that follows a higher count begins a place later.
    from_left = np.zeros(len(heads), bool)
    from_left[1:] = counts[heads[1:] - 1] > counts[heads[1:]]
    odd = np.repeat((heads + from_left) & 1, np.diff(np.append(heads, n)))
    pick = (counts > 0) & (odd == np.arange(n) & 1)
    pick[heads[from_left]] = False
    pick[:-1] &= counts[1:] <= counts[:-1]
    return np.flatnonzero(pick)


def _grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, number of each one's, counts): np.unique by one sort of code and place in one number."""
    bits = len(codes).bit_length()
    if not len(codes) or int(codes.max()) >> (62 - bits):
        return np.unique(codes, return_inverse=True, return_counts=True)
    packed_codes = np.sort(codes << bits | np.arange(len(codes)))
    ordered = packed_codes >> bits
    first = np.ones(len(codes), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(codes), np.int64)
    which[packed_codes & ((1 << bits) - 1)] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    return ordered[starts], which, np.diff(np.append(starts, len(codes)))


def _round(seq: np.ndarray, weights: np.ndarray | None, base: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, shorter sequence): the frequent pairs of one pass become symbols from ``base`` on."""
    inside = (seq[:-1] >= 0) & (seq[1:] >= 0)
    places = np.flatnonzero(inside)
    codes = seq[places] * base + seq[places + 1]
    pairs, which, counts = _grouped(codes)
    if weights is not None:
        counts = np.bincount(which, weights[places], minlength=len(pairs)).astype(np.int64)
    own = np.zeros(len(inside), np.int64)
    often = counts[which]
    own[places] = np.where(often >= least, often, 0)
    symbol_at = np.empty(len(inside), np.int64)
    symbol_at[places] = which
    at = _chosen(own)
    used = np.bincount(symbol_at[at], None if weights is None else weights[at], minlength=len(pairs))
    keep = used >= least
    numbers = base + np.cumsum(keep) - 1
    at = at[keep[symbol_at[at]]]
    out = seq.copy()
    out[at] = numbers[symbol_at[at]]
    pairs = pairs[keep]
    left = np.ones(len(seq), bool)
    left[at + 1] = False
    return np.column_stack([pairs // base, pairs % base]).astype(np.int32), out[left]


def compress(seq: np.ndarray, n_ids: int, least: int = LEAST, worth: float = WORTH) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence). Rule i makes symbol n_ids + i of its two symbols, which are ids or
    earlier symbols. Negative values are never replaced. Every round counts all pairs anew."""
    rules, seq = [np.empty((0, 2), np.int32)], seq.astype(np.int64)
    while len(seq) > 1:
        more, shorter = _round(seq, None, n_ids + sum(map(len, rules)), least)
        gain = len(seq) - len(shorter)
        rules.append(more)
        seq = shorter
        if gain <= worth * len(seq):
            break
    return np.concatenate(rules), seq.astype(np.int32)


def expansion_lengths(rules: np.ndarray, n_ids: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - n_ids] if a >= n_ids else 1) + (out[b - n_ids] if b >= n_ids else 1))
    return np.array(out, np.int32)


def expand(symbols: np.ndarray, rules: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids that symbols stand for, one level of rules at a time."""
    while True:
        ruled = symbols >= n_ids
        if not ruled.any():
            return symbols
        sizes = np.where(ruled, 2, 1)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]), symbols.dtype)
        out[(ends - sizes)[~ruled]] = symbols[~ruled]
        pair = rules[symbols[ruled] - n_ids]
        at = (ends - sizes)[ruled]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        symbols = out


def word_rules(
    lengths: np.ndarray, flat: np.ndarray, counts: np.ndarray, n_ids: int, least: int = LEAST
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols): ``word_grammar`` over the ids of all words, one word after the other."""
    lengths = lengths.astype(np.int64)
    weights = np.repeat(counts, lengths + 1)
    seq = np.full(len(flat) + len(lengths), END_OF_DOC, np.int64)
    ends = np.cumsum(lengths + 1) - 1
    body = np.ones(len(seq), bool)
    body[ends] = False
    seq[body] = flat
    rules = [np.empty((0, 2), np.int32)]
    while len(seq) > 1:
        more, shorter = _round(seq, weights, n_ids + sum(map(len, rules)), least)
        gain = len(seq) - len(shorter)
        rules.append(more)
        ends = np.flatnonzero(shorter == END_OF_DOC)
        weights, seq = np.repeat(counts, np.diff(np.concatenate([[-1], ends]))), shorter
        if gain <= WORTH * len(seq):
            break
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    return np.concatenate(rules), sizes, seq[seq >= 0].astype(np.int32)


def word_grammar(words: list[list[int]], counts: np.ndarray, n_ids: int, least: int = LEAST) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rules from pairs inside words, each counted as often as its word stands in the
    shard, and the words in the new symbols. What compress() would find inside words, found
    on the distinct ones."""
    rules, sizes, symbols = word_rules(*packed(words), counts, n_ids, least)
    return rules, np.split(symbols, np.cumsum(sizes)[:-1])


class _Numbers(dict):
    """Numbers of words in the order of their coming."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordIds:
    """The ids of a task's words, each encoded once."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.lengths, self.values = np.empty(0, np.int32), np.empty(0, np.int32)
        self.more: list[np.ndarray] = []

    def of(self, table: list[str]) -> np.ndarray:
        """Numbers of words."""
        found = np.fromiter(map(self.numbers.__getitem__, table), np.int32, len(table))
        if self.numbers.new:
            lengths, values = encoded(self.tokenizer, self.numbers.new)
            self.numbers.new = []
            self.lengths = np.concatenate([self.lengths, lengths])
            self.more.append(values)
        return found

    def keep(self, numbers: np.ndarray) -> None:
        """Forgets all words but those of the ascending numbers, which are numbered from 0."""
        lengths, values = gathered(numbers, *self.lists())
        words = list(self.numbers)
        self.clear()
        self.numbers.update(zip((words[i] for i in numbers), range(len(numbers))))
        self.lengths, self.values = lengths.astype(np.int32), values

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of all words."""
        self.values, self.more = np.concatenate([self.values, *self.more]), []
        return self.lengths, self.values


def _writer(tokenizer_path: str, end_id: int) -> Callable:
    """A row for each shard of the sorted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(tokenizer_path)
        splitter, n_ids = Splitter(tokenizer), max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        known = WordIds(tokenizer)
        task, done = TaskContext.get().partitionId(), 0
        codes: list[np.ndarray] = []
        others: list[pa.Array] = []
        n = 0

        def closed() -> pa.RecordBatch:
            numbers = np.concatenate(codes)
            counts = np.bincount(numbers, minlength=len(known.numbers))
            table = np.flatnonzero(counts)  # the words of this shard
            own, flat = gathered(table, *known.lists())
            rules, lengths, values = word_rules(own, flat, counts[table], n_ids)
            lengths, values = np.append(lengths, 2), np.append(values, np.array([end_id, END_OF_DOC], np.int32))
            place = np.empty(len(counts), np.int64)
            place[table] = np.arange(len(table))
            per_doc = np.array([len(c) + 1 for c in codes], np.int64)
            full = np.full(int(per_doc.sum()), len(table), np.int64)
            body = np.ones(len(full), bool)
            body[np.cumsum(per_doc) - 1] = False
            full[body] = place[numbers]
            seq = gathered(full, lengths, values)[1]
            more, seq = compress(seq, n_ids + len(rules))
            rules = np.concatenate([rules, more])
            ends = np.flatnonzero(seq == END_OF_DOC)
            symbols = np.diff(np.concatenate([[-1], ends])) - 1
            seq = seq[seq != END_OF_DOC]
            sizes = expansion_lengths(rules, n_ids)
            own = np.where(seq >= n_ids, sizes[np.maximum(seq - n_ids, 0)] if len(sizes) else 1, 1)
            tokens = np.add.reduceat(own, np.cumsum(symbols) - symbols)
            names = pa.concat_arrays(others)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task], pa.int32()),
                    pa.array([done], pa.int64()),
                    pa.array([int(tokens.sum())], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    pa.array([shrunk(symbols, tokens)], pa.binary()),
                    pa.array([shrunk(rules.ravel(), sizes)], pa.binary()),
                    pa.array([shrunk(seq)], pa.binary()),
                ],
                names=["part", "shard", "n_ids", "doc_ids", "documents", "rules", "sequence"],
            )

        for batch in pieces(batches, most=4 << 20, column="text"):
            sizes, found = splitter.words([t or "" for t in batch.column("text").to_pylist()])
            numbers, table = distinct([found])
            numbers = known.of(table.to_numpy(zero_copy_only=False).tolist())[numbers]
            ends = np.cumsum(sizes)
            ids_before = np.concatenate([[0], np.cumsum(known.lengths[numbers], dtype=np.int64)])
            n_ids_of = np.diff(ids_before[np.concatenate([[0], ends])]).tolist()
            for i, own in enumerate(np.split(numbers, ends[:-1])):
                codes.append(own)
                n += n_ids_of[i] + 1
                others.append(batch.column("doc_id").slice(i, 1))
                if n >= SHARD_IDS:
                    yield closed()
                    codes, others, n, done = [], [], 0, done + 1
            if len(known.numbers) > KNOWN_WORDS:
                # What the open shard has of words is numbered anew.
                kept = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int32)
                known.keep(kept)
                codes = [kept.searchsorted(c).astype(np.int32) for c in codes]
        if codes:
            yield closed()

    return run


def write(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all rows, each with the end id after it, in ascending order of the id.

    A file row is a shard: (part, shard) in order, n_ids, doc_ids, documents (symbols and
    ids of each), rules (pairs, expansion lengths) and sequence. Null texts are empty and
    have the end id alone; rows with a null id come first; rows with one id stay in the
    order of their texts. The range cut samples its keys to the driver, so beside the id it
    has the first characters of a text alone; the sort inside a part is by whole texts. Only the named columns are read; no rows write no shard.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    (
        narrow.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, KEY_CHARS).asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(
            _writer(tokenizer_path, end_id),
            f"part int, shard long, n_ids long, doc_ids array<{id_type}>, documents binary, rules binary, sequence binary",
        )
        .write.option("compression", "none")
        .parquet(path)
    )


def _reader(n_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                symbols, tokens = grown(batch.column("documents")[i].as_py(), 2)
                rules, sizes = grown(batch.column("rules")[i].as_py(), 2)
                (sequence,) = grown(batch.column("sequence")[i].as_py(), 1)
                # Each rule is expanded once; what the symbols stand for is then gathered.
                made = expand(np.arange(n_ids, n_ids + len(sizes), dtype=np.int32), rules.reshape(-1, 2), n_ids)
                lengths = np.concatenate([np.ones(n_ids, np.int32), sizes])
                ids = gathered(sequence, lengths, np.concatenate([np.arange(n_ids, dtype=np.int32), made]))[1]
                cuts = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
                n = len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("part")[i].as_py()] * n, pa.int32()),
                        pa.array([batch.column("shard")[i].as_py()] * n, pa.int64()),
                        batch.column("doc_ids")[i].values,
                        pa.array(cuts[:-1], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return run


def document(shard: dict, i: int, n_ids: int) -> np.ndarray:
    """Ids of the i-th document of a shard row, without expanding the others."""
    symbols = grown(shard["documents"], 2)[0]
    rules = grown(shard["rules"], 2)[0].reshape(-1, 2)
    start = int(symbols[:i].sum())
    return expand(grown(shard["sequence"], 1)[0][start : start + int(symbols[i])], rules, n_ids)


def symbols_of(tokenizer_path: str, end_id: int = 2) -> int:
    """How many ids there are; rules are numbered from there on."""
    return max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)


def read_digests(files: DataFrame, n_ids: int, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the files; start counts the
    ids of all documents before it. Only shards are numbered in one place, not documents."""
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    rows = files.drop("n_ids").mapInArrow(
        _reader(n_ids), f"part int, shard long, doc_id {id_type}, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "shard"]).select(
        F.col("doc_id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
