"""BPE encoding and decoding through a table of distinct words.

Texts are split into words and each block of documents becomes its words' numbers in the
block and the block's distinct words. Words of all blocks meet by hash, each distinct
word is encoded once, and its ids go back to the blocks that have it, where the numbers
say at which positions they stand. Decoding looks each id up in the tokenizer's table of
pieces. Between tasks go the words of whole blocks, not a row for each word, and no documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dwellkit.llm.pretokens import Splitter, distinct, encode_words, gathered, grown, packed, shrunk, starts_of, vocabulary
from dwellkit.llm.store import stored_by
from dwellkit.llm.text import as_bytes, pieces

#: A block is closed at so many words or bytes of text; a longer text is a block by itself.
BLOCK_WORDS, BLOCK_BYTES = 2_000_000, 16 << 20
#: Row of a block that holds its documents; the others hold words, by bucket.
DOCS = -1


def _blocks(tokenizer_path: str, buckets: int) -> Callable:
    """One row of documents and one of words in each bucket for each block.

    The number of a block is its task's and a count: only the rows of the attempt that
    Spark commits are read later, so numbers are one block's each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(Tokenizer.from_file(tokenizer_path))
        task, done = TaskContext.get().partitionId(), 0
        words: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        others: list[pa.Array] = []
        total = held = 0

        def closed() -> pa.RecordBatch:
            # Numbered anew by how often they stand in the block, words have small numbers;
            # of equally frequent ones those of a bucket follow each other, so that buckets take little room.
            numbers, table = distinct(words)
            raw = as_bytes(table)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int32, len(raw))
            order = np.lexsort((bucket, -np.bincount(numbers, minlength=len(raw))))
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            raw, bucket = [raw[i] for i in order], bucket[order]
            rows = [(DOCS, shrunk(np.concatenate(sizes), rank[numbers], bucket))]
            by_bucket = np.argsort(bucket, kind="stable")
            for group in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if len(raw) else []:
                rows.append((int(bucket[group[0]]), _pack_words([raw[i] for i in group])))
            ids = pa.concat_arrays(others)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids), *[len(ids)] * (len(rows) - 1)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 24 | done] * len(rows), pa.int64()),
                    pa.array([b for b, _ in rows], pa.int32()),
                    lists,
                    pa.array([x for _, x in rows], pa.binary()),
                ],
                names=["block", "bucket", "ids", "payload"],
            )

        for batch in pieces(batches, most=1 << 20, column="text"):
            own, found = splitter.words([t or "" for t in batch.column("text").to_pylist()])
            sizes.append(own)
            words.append(found)
            others.append(batch.column("doc_id"))
            total, held = total + len(found), held + found.nbytes
            if total >= BLOCK_WORDS or held >= BLOCK_BYTES:
                yield closed()
                words, sizes, others, total, held, done = [], [], [], 0, 0, done + 1
        if others:
            yield closed()

    return run


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.int32, len(words)).tobytes()
    raw = len(words).to_bytes(4, "little") + lengths + b"".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_words(value: bytes) -> list[str]:
    raw = pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, np.int32, n, 4)).tolist()
    base = 4 + 4 * n
    return [raw[base + a : base + b].decode() for a, b in zip([0, *ends], ends)]


def _encoder(tokenizer_path: str) -> Callable:
    """Ids of the words of each row; rows of a bucket follow each other and share its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(tokenizer_path)
        bucket, known = None, {}
        for batch in batches:
            out = []
            for now, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                if now != bucket:
                    bucket, known = now, {}
                words = _unpack_words(payload.as_py())
                new = [w for w in words if w not in known]
                known.update(zip(new, encode_words(tokenizer, new)))
                out.append(shrunk(*packed([known[w] for w in words])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())],
                names=["block", "bucket", "payload"],
            )

    return run


def _joiner(tokenizer_path: str, finish: Callable, columns: dict[str, pa.DataType]) -> Callable:
    """Each document's ids from its block's row of documents and rows of encoded words."""
    known: list[Pieces] = []  # one for all blocks of a task

    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        if not known:
            known.append(Pieces(vocabulary(tokenizer_path)))
        ids = documents.column("ids").combine_chunks().flatten()
        sizes, codes, bucket = grown(documents.column("payload")[0].as_py(), 3)
        by_bucket = np.argsort(words.column("bucket").to_numpy())
        encoded = [grown(words.column("payload")[int(i)].as_py(), 2) for i in by_bucket]
        lengths, values = (np.concatenate([np.empty(0, np.int32), *(x[k] for x in encoded)]) for k in (0, 1))
        first = starts_of(lengths)  # once a block, not once a document
        # Inside a bucket words are in the order of their numbers.
        place = np.empty(len(bucket), np.int32)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket), dtype=np.int32)
        codes = place[codes]
        cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        out = []
        for start in range(0, len(sizes), 256):
            end = min(start + 256, len(sizes))
            rows = [finish(gathered(codes[a:b], lengths, values, first)[1], known[0]) for a, b in zip(cuts[start:end], cuts[start + 1 : end + 1])]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), columns.values())]
            out.append(pa.RecordBatch.from_arrays([ids.slice(start, end - start), *made], names=["doc_id", *columns]))
        return pa.Table.from_batches(out)

    return run


class Pieces:
    """The join of ids with the tokenizer's pieces: a lookup in a table of its fixed size."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.first = starts_of(self.lengths)

    def text(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no text become replacement characters."""
        raw = gathered(ids, self.lengths, self.bytes, self.first)[1].tobytes()
        return raw.decode("utf-8", "replace").encode()


def _encoded(
    docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, finish: Callable, columns: dict[str, pa.DataType], names: str
) -> DataFrame:
    """(id, what ``finish`` makes of the document's ids) for each row.

    Blocks are a table bucketed by block, so documents stay where they were written and
    only the ids of distinct words are dealt to them.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored_by(
        narrow.mapInArrow(
            _blocks(tokenizer_path, 4 * tasks), f"block long, bucket int, ids array<{id_type}>, payload binary"
        ),
        "block",
        tasks,
        "word_blocks",
    )
    words = (
        blocks.where(F.col("bucket") != DOCS)
        .select("block", "bucket", "payload")
        .repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encoder(tokenizer_path), "block long, bucket int, payload binary")
        .repartition(tasks, "block")
    )
    documents = blocks.where(F.col("bucket") == DOCS).select("block", "ids", "payload")
    out = documents.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(
        _joiner(tokenizer_path, finish, columns), f"doc_id {id_type}, {names}"
    )
    return out.withColumnRenamed("doc_id", id_col)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row: the ids the tokenizer gives for the whole text.

    Null and empty texts have no ids; repeated rows are encoded each; null ids stay null.
    Strings of special tokens in a text are those tokens. Only the named columns are read.
    """

    def finish(ids: np.ndarray, pieces_of: Pieces) -> tuple:
        return (ids.tolist(),)

    return _encoded(docs, tokenizer_path, id_col, text_col, finish, {"ids": pa.list_(pa.int32())}, "ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of ids. Null ids decode as an empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = Pieces(vocabulary(tokenizer_path))
        for batch in batches:
            texts = [pieces_of.text(np.array(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    narrow = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {id_type}, text string").withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row: what ``encode`` and ``decode``
    give, as digests of little-endian 32-bit ids and of the decoded text in UTF-8."""

    def finish(ids: np.ndarray, pieces_of: Pieces) -> tuple:
        raw = ids.astype("<u4").tobytes()
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(pieces_of.text(ids)).hexdigest()

    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    names = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, tokenizer_path, id_col, text_col, finish, columns, names)
