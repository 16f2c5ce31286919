"""Toxicity by a support vector machine on a subsequence string kernel.

Two words are alike as far as they share subsequences of three letters, each weighted by
how far its letters lie apart, so a word with letters put in between or with another
ending stays close to what it was made from. A sentence is described by its words' largest
kernel values with a few landmark words (Nyström features), a linear SVM is trained on
sentences of labelled documents, and a document scores as its worst sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.store import numbered, stored
from dwellkit.llm.text import cut, pieces

#: Weight lost with each letter that a subsequence spans.
DECAY = 0.6
#: Letters of a word that are looked at together; a longer word is read in windows that overlap by half.
SPAN = 16
LANDMARKS = 96
#: Labelled rows the model is fitted on: the bound of its training sample.
TRAINING_ROWS = 12_000
#: Landmarks are words whose kernel with every earlier landmark is below this.
APART = 0.55
#: Times that the machine is trained again with labels of its own for toxic documents' sentences, its ridge, and
#: the most Newton steps of a training.
REFITS = 3
RIDGE = 1e-4
STEPS = 30
#: Sentences of a document that are one row of the stored table.
PART = 2048
#: Sentences whose words are looked up together, and the words of a sentence that are.
TOGETHER, LONG = 4096, 128
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_LETTERS = re.compile(r"[^\W\d_]+")
_OTHERS = re.compile(r"(?:[^\w\n]|[\d_])+")
# a-z have numbers of their own, other letters share the rest; triples have the cube of that.
_ALPHABET = 64


def blanks() -> np.ndarray:
    """Whether each character is a blank; none lies above U+FFFF."""
    out = np.zeros(0x110000, bool)
    out[:0x10000] = [chr(c).isspace() for c in range(0x10000)]
    return out


def letters_of(word: str) -> str:
    """Lower-case letters alone: marks and digits between them are gaps that don't count."""
    low = word.lower()
    return low if low.isalpha() else "".join(_LETTERS.findall(low))


def letters_of_all(words: list[str]) -> list[str]:
    """``letters_of`` of each of many words without line ends."""
    if not words:
        return []
    low = "\n".join(words).lower().split("\n")
    marked = [i for i, word in enumerate(low) if not word.isalpha()]
    if marked:
        for i, word in zip(marked, _OTHERS.sub("", "\n".join([low[i] for i in marked])).split("\n")):
            low[i] = word
    return low


def numbers_of(words: list[str]) -> np.ndarray:
    """Letter numbers of words of one length, a row for each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)
    return np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 37)


def words_of(sentence: str) -> list[str]:
    """Words as letters; letters that stand one by one are a word together."""
    out: list[str] = []
    single: list[str] = []
    for raw in sentence.split():
        word = letters_of(raw)
        if len(word) == 1:
            single.append(word)
            continue
        if len(single) > 2:
            out.append("".join(single))
        single = []
        if len(word) > 2:
            out.append(word)
    if len(single) > 2:
        out.append("".join(single))
    return out


def windows(word: str) -> list[str]:
    if len(word) <= SPAN:
        return [word]
    return [word[i : i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


class Kernel:
    """Subsequence features of words, by word length: all triples of places and their weights."""

    def __init__(self) -> None:
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def triples(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.places:
            at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
            self.places[n] = at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)
        return self.places[n]

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms) of words of one length: the code of each triple of places, a column for
        each word, and the norm of its weights once those of equal codes are summed."""
        at, _ = self.triples(len(words[0]))
        letters = np.ascontiguousarray(numbers_of(words).T)
        codes = (letters[at[:, 0]] * _ALPHABET + letters[at[:, 1]]) * _ALPHABET + letters[at[:, 2]]
        # The squared norm is a sum over pairs of triples with equal letters; running sums over
        # pairs of places give it letter by letter.
        decay = DECAY ** np.arange(len(letters), dtype=np.float64)
        both = (decay[:, None] * decay[None, :])[:, :, None]
        same = (letters[:, None] == letters[None, :]).astype(np.float64)
        second = same * _before(same / both)
        # One place after the other, so that a word's sum is the same beside any other words.
        return codes, np.sqrt(sum(sum(same * (both * DECAY**2) * _before(second))))

    def table(self, landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(first entry of each triple, landmarks, values, number of landmarks): which landmarks
        have a triple and with what weight, ordered by triple."""
        codes, places, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for j, word in enumerate(landmarks):
            own, norm = self.features([word])
            distinct, at = np.unique(own[:, 0], return_inverse=True)
            codes.append(distinct)
            places.append(np.full(len(distinct), j))
            values.append(np.bincount(at, weights=self.triples(len(word))[1]) / norm[0])
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(_ALPHABET**3 + 1)).astype(np.int32)
        return first, np.concatenate(places)[order], np.concatenate(values)[order], len(landmarks)

    def against(self, words: list[str], table: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> np.ndarray:
        """Kernel of each word with each landmark; the largest of a long word's windows."""
        first, places, values, width = table
        entries = np.diff(first)
        known = entries > 0
        out = np.zeros((len(words), width), np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, word in enumerate(words):
            for part in windows(word):
                by_length.setdefault(len(part), []).append((i, part))
        for n, own in by_length.items():
            weights = self.triples(n)[1]
            step = max(1, 100_000 // max(1, len(weights)))
            for start in range(0, len(own), step):
                some = own[start : start + step]
                codes, norms = self.features([w for _, w in some])
                # Triples that no landmark has add nothing; others are spread over the landmarks that have them.
                codes = codes.ravel()
                which = np.flatnonzero(known[codes])
                code, col = codes[which], which // len(some)
                times = entries[code]
                stops = np.cumsum(times)
                each = np.repeat(np.arange(len(code)), times)
                at = np.arange(len(each)) + (first[code] - (stops - times))[each]
                cell = ((which - col * len(some)) * width)[each] + places[at]
                sums = np.bincount(cell, weights[col][each] * values[at], len(some) * width)
                sums = sums.reshape(len(some), width) / norms[:, None]
                which = np.array([i for i, _ in some])
                if n < SPAN:
                    out[which] = np.maximum(out[which], sums)
                else:
                    np.maximum.at(out, which, sums.astype(np.float32))
        return out


def _before(x: np.ndarray) -> np.ndarray:
    """For each pair of places, the first two axes, the sum over all pairs with both places before it."""
    out = np.zeros_like(x)
    for i in range(1, len(x)):
        np.add(out[i - 1, 1:], x[i - 1, :-1], out=out[i, 1:])
    for j in range(2, len(x)):
        out[:, j] += out[:, j - 1]
    return out


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on the kernel values themselves: the Nyström map is folded in
    intercept: float
    slope: float
    shift: float


def _sentences(text: str) -> list[list[str]]:
    return [w for w in map(words_of, _SENTENCE.split(text)) if w]


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, column="text"):
        rows = [sorted({w for s in _sentences(t or "") for w in s}) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.string()))], names=["label", "words"])


def choose_landmarks(sample: DataFrame, n: int = LANDMARKS) -> list[str]:
    """Words that tell the labels apart best, each unlike those chosen before it.

    A word's worth is the log ratio of its shares of documents, times the root of its
    number. Words of at least three documents count; the best fifty times ``n`` are compared.
    """
    words = sample.select("label", "text").mapInArrow(_document_words, "label int, words array<string>")
    sums = (
        words.select("label", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    )
    sizes = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    bad, good = (sizes[0] or 0) + 1.0, (sizes[1] or 0) + 1.0
    ratio = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good)
    worth = F.abs(ratio) * F.sqrt(F.when(ratio > 0, F.col("bad")).otherwise(F.col("good") * 0.1))
    best = (
        sums.where((F.col("bad") + F.col("good") >= 3) & (F.length("word") <= SPAN))
        .orderBy(worth.desc(), "word")
        .limit(50 * n)
        .select("word")
        .toPandas()["word"]
        .tolist()
    )
    kernel = Kernel()
    chosen: list[str] = []
    table = kernel.table([])
    for start in range(0, len(best), 64):
        some = best[start : start + 64]
        near = kernel.against(some, table) if chosen else np.zeros((len(some), 1))
        own = kernel.against(some, kernel.table(some))
        fresh: list[int] = []
        for i in range(len(some)):
            if near[i].max() < APART and all(own[i, j] < APART for j in fresh) and len(chosen) + len(fresh) < n:
                fresh.append(i)
        chosen += [some[i] for i in fresh]
        table = kernel.table(chosen)
        if len(chosen) == n:
            break
    return chosen


def _pooler(landmarks: list[str]) -> Callable:
    """Kernel maxima of all sentences of each labelled document, a row of floats for each; a
    long document comes in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(landmarks)
        for batch in pieces(batches, most=2 << 20, column="text"):
            keys, labels, rows = [], [], []
            found = describe.texts([t or "" for t in batch.column("text").to_pylist()])
            for key, label, own in zip(batch.column("row_id").to_pylist(), batch.column("label").to_pylist(), found):
                for start in range(0, len(own), PART):
                    keys.append(key)
                    labels.append(label)
                    rows.append(own[start : start + PART].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(labels, pa.int32()), pa.array(rows, pa.binary())],
                names=["row_id", "label", "values"],
            )

    return run


class _Numbers(dict):
    """Row numbers of words as they stand in a text: 0 where there is no word, -1 for a letter by itself."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def add(self, raws: list[str]) -> None:
        """Looks at many new words at once; words hold no line ends."""
        words = self.words
        for raw, word in zip(raws, letters_of_all(raws)):
            self[raw] = words.setdefault(word, len(words) + 1) if len(word) > 2 else -1 if len(word) == 1 else 0

    def of(self, word: str) -> int:
        return self.words.setdefault(word, len(self.words) + 1)

    def kept(self, rows: np.ndarray) -> _Numbers:
        """With these rows' words alone, numbered in this order."""
        out, place = _Numbers(), np.zeros(len(self.words) + 1, np.int64)
        place[rows] = np.arange(1, len(rows) + 1)
        places = place.tolist()
        out.words = {word: places[number] for word, number in self.words.items() if places[number]}
        out.update((raw, places[number]) for raw, number in self.items() if number > 0 and places[number])
        return out


class Describer:
    """Kernel maxima of sentences, each distinct word computed once while it is remembered."""

    def __init__(self, landmarks: list[str], most: int = 150_000):
        self.kernel, self.most = Kernel(), most
        self.table = self.kernel.table(landmarks)
        self.numbers, self.blanks = _Numbers(), blanks()
        self.rows = np.zeros((1, len(landmarks)), np.float32)
        self.used = np.zeros(1, np.int64)  # how often each row's word came

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row numbers of the words of all texts, where each sentence begins among them, where each text's
        sentences begin, and the end). Words without a row have 0; so have blanks before a text's first word."""
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        white, head = self.blanks[codes], np.zeros(len(codes), bool)
        head[(ends - sizes)[sizes > 0]] = True
        start = head.copy()
        start[1:] |= ~white[1:] & white[:-1]
        at = np.flatnonzero(start)
        # A sentence ends with marks before a blank, or with a line: what ``_SENTENCE`` says.
        stop = ~white
        stop[:-1] &= white[1:] | head[1:]
        stops, blank = at.copy(), white[at]
        stops[~blank] = np.flatnonzero(stop) + 1
        last = codes[np.maximum(stops - 1, 0)]
        over = (stops > at) & (np.append(at[1:], len(codes)) > stops) & ((last == 46) | (last == 33) | (last == 63))
        over[at.searchsorted(np.flatnonzero(codes == 10), "right") - 1] = True
        first = head[at]
        first[1:] |= over[:-1]
        begins = np.flatnonzero(first)
        letters = codes[~white]
        before = np.cumsum(stops - at) - (stops - at)
        coded = cut(letters.tobytes().decode("utf-32-le"), letters, before).dictionary_encode()
        raws = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.numbers.add([raw for raw in raws if raw not in self.numbers])
        own = np.fromiter(map(self.numbers.__getitem__, raws), np.int64, len(raws))[coded.indices.to_numpy()]
        bounds = at[begins].searchsorted(np.concatenate([[0], ends]))
        alone = own < 0
        if alone.any():
            # Three single letters or more make words together; fewer make none.
            which = np.flatnonzero(np.add.reduceat(alone, begins, dtype=np.int64) > 2)
            end = np.append(at[begins], len(codes))
            more = [[*map(self.numbers.of, words_of(joined[end[i] : end[i + 1]]))] for i in which]
            added = np.fromiter(map(len, more), np.int64, len(more))
            own = np.insert(np.maximum(own, 0), np.repeat(begins[which], added), np.fromiter(chain.from_iterable(more), np.int64, int(added.sum())))
            shift = np.zeros(len(begins) + 1, np.int64)
            shift[which + 1] = added
            begins = begins + np.cumsum(shift)[:-1]
        return own, begins, bounds

    def forget(self) -> None:
        """Keeps the words that came again, unless those are many too."""
        again = np.flatnonzero(self.used > 1)
        if len(again) > self.most // 2:
            again = again[:0]
        self.numbers = self.numbers.kept(again)
        self.rows = np.concatenate([self.rows[:1], self.rows[again]])
        self.used = np.zeros(len(self.rows), np.int64)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > 2 * self.most or len(self.rows) > self.most:
            self.forget()
        own, begins, bounds = self.sentences(texts)
        new = list(islice(self.numbers.words, len(self.rows) - 1, None))
        if new:
            self.rows = np.concatenate([self.rows, self.kernel.against(new, self.table)])
        self.used = np.pad(self.used, (0, len(new))) + np.bincount(own, minlength=len(self.rows))
        self.used[0] = 0
        # Sentences without a word are left out.
        some = np.maximum.reduceat(own, begins) > 0 if len(begins) else np.empty(0, bool)
        out = []
        for a, b in _spans(bounds, TOGETHER):
            best = self.maxima(own, begins[bounds[a] : bounds[b]], begins[bounds[b]] if bounds[b] < len(begins) else len(own))
            for x, y in zip(bounds[a:b], bounds[a + 1 : b + 1]):
                out.append(best[x - bounds[a] : y - bounds[a]][some[x:y]])
        return out

    def maxima(self, own: np.ndarray, begins: np.ndarray, end: int) -> np.ndarray:
        """The largest value of each landmark over the words of each sentence."""
        sizes = np.diff(np.append(begins, end))
        order = np.argsort(-sizes, kind="stable")
        out = np.zeros((len(begins), self.rows.shape[1]), np.float32)
        if not len(begins):
            return out
        # The k-th words of all sentences that have one at once, longest sentences first; of very long ones the rest by itself.
        best, falling, starts = out[order], sizes[order], begins[order]
        for k in range(min(int(falling[0]), LONG)):
            n = int(np.searchsorted(-falling, -k, "left"))
            np.maximum(best[:n], self.rows[own[starts[:n] + k]], out=best[:n])
        for i in range(int(np.searchsorted(-falling, -LONG, "left"))):
            for at in range(LONG, int(falling[i]), PART):
                rows = self.rows[own[starts[i] + at : starts[i] + min(at + PART, int(falling[i]))]]
                np.maximum(best[i], rows.max(axis=0), out=best[i])
        out[order] = best
        return out


def _spans(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Texts from a to b that have so many sentences together, or a single one."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b
        a = b


def _whitening(landmarks: list[str]) -> np.ndarray:
    """K^(-1/2) of the landmarks, which turns kernel values into Nyström features."""
    kernel = Kernel()
    values, vectors = np.linalg.eigh(kernel.against(landmarks, kernel.table(landmarks)).astype(np.float64))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from margins to labels."""
    weight = np.full(len(x), 1 / max(1, len(x)))

    def loss(a: float, b: float) -> float:
        return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (a * x + b))).sum() + 1e-3 * a * a / 2)

    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        # A whole step may overshoot where nearly all documents lie far on one side.
        while np.abs(step).max() > 1e-8 and loss(a - step[0], b - step[1]) > loss(a, b):
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def drawn(labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The (doc_id, label) that ``fit`` would draw, from the labels alone: at most ``rows``,
    half of them toxic where there are so many. No text is read for it."""
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    usable = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    halves = [usable.where(F.col("label") == y).orderBy(draw, "doc_id").limit(rows // 2) for y in (0, 1)]
    return halves[0].unionByName(halves[1])


def fit(labelled: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """The model of labelled (doc_id, text, label 0 or 1).

    At most ``rows`` documents are used, half of them toxic where there are so many, drawn
    by a hash of their ids. Documents with a null label are left out. Without both labels the model
    scores everything 0.5 or below.
    """
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    usable = labelled.where("label in (0, 1)").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    halves = [usable.where(F.col("label") == y).orderBy(draw, "text").limit(rows // 2) for y in (0, 1)]
    sample = halves[0].unionByName(halves[1])
    sample = numbered(sample, "toxicity-sample")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    landmarks = choose_landmarks(sample) if len(counts) == 2 else []
    if not landmarks:
        return Model([], np.zeros(0), -1.0, 1.0, 0.0)
    white = _whitening(landmarks)
    tasks = max(2, 2 * sample.sparkSession.sparkContext.defaultParallelism)
    sentences = stored(
        sample.repartition(tasks, "row_id").mapInArrow(_pooler(landmarks), "row_id long, label int, values binary"),
        "toxicity-sentences",
    )
    # First every sentence bears its document's label. Then a toxic document's sentences bear
    # the side on which the machine before sees them, and its worst one is always toxic.
    # That first labelling counts each sentence alike: balanced, a toxic document's plain sentences would outvote their like.
    w, least = np.zeros(len(landmarks) + 1), None
    for _ in range(REFITS + 1):
        w = _separator(sentences, white, w, least)
        worst = _worst(sentences, white, w)
        least = w, {key: min(0.0, margin) for key, (label, margin) in worst.items() if label == 1}
    labels, margins = (np.array(x, np.float64) for x in zip(*worst.values()))
    slope, shift = _logistic(margins, labels)
    return Model(landmarks, white @ w[:-1], float(w[-1]), slope, shift)


def _features(raw: bytes, white: np.ndarray) -> np.ndarray:
    """Nyström features of sentences, a row for each, and a one."""
    x = np.frombuffer(raw, np.float32).reshape(-1, len(white)) @ white
    return np.column_stack([x, np.ones(len(x))])


def _worst(sentences: DataFrame, white: np.ndarray, w: np.ndarray) -> dict[int, tuple[int, float]]:
    """(label, largest margin) of each document of the sample by its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [float((_features(raw, white) @ w).max()) for raw in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("label"), pa.array(margins, pa.float64())],
                names=["row_id", "label", "margin"],
            )

    rows = sentences.mapInArrow(run, "row_id long, label int, margin double")
    rows = rows.groupBy("row_id", "label").agg(F.max("margin").alias("margin")).orderBy("row_id")
    return {r["row_id"]: (r["label"], r["margin"]) for r in rows.collect()}


def _sums(sentences: DataFrame, white: np.ndarray, w: np.ndarray, least: tuple | None) -> list[tuple]:
    """(rows, loss, gradient, Hessian) of the squared hinge at ``w`` over the clean and over the toxic sentences.

    ``least``: an earlier machine and the margin by it from which a sentence of each toxic
    document is toxic; without it all of them are. A task sends on its sums alone.
    """
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size + 1, size + 1))
        for batch in batches:
            for key, label, raw in zip(*(batch.column(c).to_pylist() for c in ("row_id", "label", "values"))):
                x = _features(raw, white)
                toxic = np.full(len(x), label == 1)
                if label == 1 and least is not None:
                    toxic = x @ least[0] >= least[1][key] - 1e-9
                sign = np.where(toxic, 1.0, -1.0)
                short = np.maximum(0, 1 - sign * (x @ w))
                for side in (0, 1):
                    own = toxic == bool(side)
                    near = own & (short > 0)
                    sums[side, 0, 0] += own.sum()
                    sums[side, 0, 1] += (short[near] ** 2).sum()
                    sums[side, 1:, 0] -= 2 * x[near].T @ (sign * short)[near]
                    sums[side, 1:, 1:] += 2 * x[near].T @ x[near]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    parts = [np.frombuffer(r["sums"]).reshape(2, size + 1, size + 1) for r in sentences.mapInArrow(run, "sums binary").collect()]
    total = np.sum(parts, axis=0)
    return [(t[0, 0], t[0, 1], t[1:, 0], t[1:, 1:]) for t in total]


def _separator(sentences: DataFrame, white: np.ndarray, start: np.ndarray, least: tuple | None) -> np.ndarray:
    """Weights and, last, intercept of a linear SVM with squared hinge loss on all sentences, by
    Newton steps whose sums are one job each. With ``least`` both classes weigh the same in all."""
    ridge = np.append(np.full(len(start) - 1, RIDGE), 1e-9)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, hessian = float((ridge * w * w).sum() / 2), ridge * w, np.diag(ridge)
        sides = _sums(sentences, white, w, least)
        for n, *own in sides:
            weight = 1 / (2 * n if least else sides[0][0] + sides[1][0]) if n else 0.0
            loss, gradient, hessian = (a + weight * b for a, b in zip((loss, gradient, hessian), own))
        return loss, gradient, hessian

    w, (now, gradient, hessian) = start, at(start)
    for _ in range(STEPS):
        step, size = np.linalg.solve(hessian, gradient), 1.0
        found = at(w - step)
        while found[0] > now and size > 1e-4:
            size /= 2
            found = at(w - size * step)
        if found[0] > now:
            break
        done = now - found[0] < 1e-6 * now
        w, (now, gradient, hessian) = w - size * step, found
        if done:
            break
    return w


def _scorer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(model.landmarks) if model.landmarks else None
        for batch in pieces(batches, most=2 << 20, column="text"):
            scores = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for own in describe.texts(texts) if describe else [[]] * len(texts):
                margin = model.intercept + (float((own @ model.weights).max()) if len(own) else 0.0)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * margin + model.shift)))))
            yield pa.RecordBatch.from_arrays(
                [*(c for c, name in zip(batch.columns, batch.schema.names) if name != "text"), pa.array(scores, pa.float64())],
                names=[*(name for name in batch.schema.names if name != "text"), "score"],
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row: the score is the worst sentence's, 0 to 1.

    An empty, null or wordless text scores as a sentence that is like no landmark.
    Repeated rows score alike; null ids stay null. Only the named columns are read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    out = narrow.mapInArrow(_scorer(model), f"doc_id {id_type}, score double")
    return out.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
