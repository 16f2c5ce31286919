"""Repeated passages by hashing units of text.

A document is cut into units: lines, paragraphs, or sentences within lines. Units are
normalised and digested; the earliest occurrence of a digest in the corpus stays, every
other one is removed, and where it stood is kept in characters of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellkit.llm.store import numbered
from dwellkit.llm.text import pieces

# What ends a unit. The marks of a sentence belong to it, blanks and line ends don't. A digest ignores
# marks, so other marks around a stop don't keep it from ending a sentence.
_ENDS = {
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+"),
    "sentence": re.compile(r"(?<![^\w\s])[^\w\s]++(?P<blank>[^\S\n]+)|\n"),
}
_STOP = re.compile(r"[.!?]")
_WORD = re.compile(r"\w+")


def _cuts(text: str, kind: str) -> Iterator[tuple[int, int]]:
    for m in _ENDS[kind].finditer(text):
        blank = m.span("blank") if kind == "sentence" else (-1, -1)
        if blank[0] < 0:
            yield m.span()
        elif _STOP.search(text, m.start(), blank[0]):
            yield blank


def units(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit that isn't blank, blanks at its ends left out."""
    at = 0
    for cut in [*_cuts(text, kind), (len(text), len(text))]:
        unit = text[at : cut[0]]
        left = len(unit) - len(unit.lstrip())
        if left < len(unit):
            yield at + left, at + len(unit.rstrip())
        at = cut[1]


def normalised(unit: str) -> str:
    """Lower-case words joined by blanks: case, marks and white space don't tell units apart."""
    return " ".join(_WORD.findall(unit.lower()))


def _cutter(kind: str, min_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20, column="text"):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, text in enumerate(batch.column("text").to_pylist()):
                number = 0
                for start, end in units(text or "", kind):
                    plain = normalised(text[start:end])
                    n_words = plain.count(" ") + 1
                    if n_words >= min_words and plain:
                        digest = hashlib.blake2b(plain.encode(), digest_size=16).digest()
                        for column, value in zip(out, (i, number, start, end, n_words, digest)):
                            column.append(value)
                        number += 1
            ids = batch.column("doc_id").take(pa.array(out[0], pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, t) for c, t in zip(out[1:], kinds))],
                names=["doc_id", "unit_no", "start", "end", "n_words", "digest"],
            )

    return run


def repeated_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    kind: str = "sentence",
    min_words: int = 6,
    min_run_words: int = 0,
) -> DataFrame:
    """(id, start, end, n_words, first_id, first_start) for each unit to remove.

    A unit goes if the same words in the same order stand in an earlier unit: of a smaller
    id, of an earlier row with that id, or further up in the text. first_id and first_start
    say where the one that stays is. Units of fewer than ``min_words`` words are left alone,
    so empty and null texts give nothing; so are those that, with the repeated ones right
    before and after them, have fewer than ``min_run_words`` words, such as a line of
    boilerplate in a text of its own. Null ids rank last. Repeated rows repeat units
    like any two documents. Only the named columns are read.

    The earliest occurrence is a grouped minimum with partial sums, so a unit that a third
    of all documents have costs a row for each task; its occurrences come back by a join
    that Spark can split.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    cut = numbered(
        texts.mapInArrow(
            _cutter(kind, min_words), f"doc_id {id_type}, unit_no long, start long, end long, n_words long, digest binary"
        ),
        "units",
        "unit_id",
    )
    # Numbers rise along a text and from row to row, so they order the units of one id.
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "unit_id", "start")
    ranked = cut.select("doc_id", "unit_no", "digest", "n_words", rank.alias("rank"), "end")
    first = ranked.groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = ranked.join(first, "digest").where("rank > first")
    if min_run_words:
        # Units of a row have consecutive numbers, so the number less the place names the row.
        row = (F.col("rank.unit_id") - F.col("unit_no")).alias("row")
        placed = again.select("*", row)
        nth = F.row_number().over(Window.partitionBy("row").orderBy("unit_no"))
        runs = placed.withColumn("run", F.col("unit_no") - nth)
        words = F.sum("n_words").over(Window.partitionBy("row", "run"))
        again = runs.withColumn("run_words", words).where(F.col("run_words") >= min_run_words)
    return (
        again.select(
            F.col("doc_id").alias(id_col),
            F.col("rank.start").alias("start"),
            "end",
            "n_words",
            F.col("first.doc_id").alias(f"first_{id_col}"),
            F.col("first.start").alias("first_start"),
        )
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, whose offsets are those of the original."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : max(at, start)])
        at = max(at, end)
    return "".join([*out, text[at:]])
