"""Splits text into the words of a byte-level BPE tokenizer, and encodes single words.

The words are those of the published pattern: contractions, letters, digits or other
signs with a blank before them, and white space. What kind a character is is asked of the
tokenizer itself, page by page, so the words are its own whatever Unicode version it knows.
"""

from __future__ import annotations

import re
from operator import attrgetter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from dwellkit.llm.text import cut

# The contractions that are words of their own.
CONTRACTIONS = ("'re", "'ve", "'ll", "'s", "'t", "'m", "'d")
BLANK, SPACE, LETTER, DIGIT, SIGN, UNASKED = 0, 1, 2, 3, 4, 255


class Splitter:
    def __init__(self, tokenizer: Tokenizer):
        self.words_of = tokenizer.pre_tokenizer.pre_tokenize_str
        self.kinds = np.full(0x110000, UNASKED, np.uint8)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(f"({'|'.join(map(re.escape, specials))})") if specials else None

    def _ask(self, page: int) -> None:
        for c in range(page << 8, (page + 1) << 8):
            x = chr(c)
            if x == " ":
                self.kinds[c] = BLANK
            elif 0xD800 <= c < 0xE000:  # no character, and in no text
                self.kinds[c] = SIGN
            else:
                joins = [k for k, before in ((LETTER, "a"), (DIGIT, "1"), (SIGN, "!")) if len(self.words_of(before + x)) == 1]
                self.kinds[c] = joins[0] if joins else SPACE

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        cuts = [*np.flatnonzero(self._starts(text, np.zeros(1, np.int64))[1]).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def _starts(self, joined: str, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(characters, whether a word starts there) of texts that stand one after the other."""
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[codes]
        if (kinds == UNASKED).any():
            for page in np.unique(codes[kinds == UNASKED] >> 8):
                self._ask(int(page))
            kinds = self.kinds[codes]
        white, head = kinds <= SPACE, np.zeros(len(codes), bool)
        head[firsts] = True
        merged = np.maximum(kinds, SPACE)
        start = head.copy()
        start[1:] |= merged[1:] != merged[:-1]
        # The last of several white characters before a word stands alone or, if a blank, with the word.
        start[1:-1] |= white[1:-1] & white[:-2] & ~white[2:] & ~head[1:-1] & ~head[2:]
        start[1:] &= white[1:] | (kinds[:-1] != BLANK) | head[1:]
        for at in np.flatnonzero((codes == 39) & start):
            own = firsts.searchsorted(at, "right")
            end = firsts[own] if own < len(firsts) else len(codes)
            found = next((c for c in CONTRACTIONS if at + len(c) <= end and joined.startswith(c, at)), None)
            if found and start[at]:
                start[at + 1 : at + len(found)] = False
                if at + len(found) < end and not white[at + len(found)]:
                    start[at + len(found)] = True
        return codes, start

    def words(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """(number of words of each text, the words of all texts): ``split`` for many texts at once."""
        joined = "".join(texts)
        if not joined or self.special and self.special.search(joined):
            lists = [self.split(t) for t in texts]
            return np.fromiter(map(len, lists), np.int64, len(lists)), pa.array([w for own in lists for w in own], pa.string())
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        firsts = np.concatenate([[0], ends[:-1]])
        codes, start = self._starts(joined, np.unique(firsts[firsts < len(joined)]))
        at = np.flatnonzero(start)
        return np.diff(at.searchsorted(np.concatenate([[0], ends]))), cut(joined, codes, at)

    def split(self, text: str) -> list[str]:
        """The words; a special token's string is a word."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out


def distinct(words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the distinct words in the order of their numbers)."""
    coded = pa.chunked_array(words, pa.string()).dictionary_encode().unify_dictionaries()
    numbers = [np.empty(0, np.int32), *(c.indices.to_numpy() for c in coded.chunks)]
    return np.concatenate(numbers), coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())


def byte_of_char() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 characters stand for their own
    byte, the rest for characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_CHARS = {b: c for c, b in byte_of_char().items()}


def encoded(tokenizer: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of words as ``Splitter`` gives them. Each is a piece by itself or a special
    token, so the tokenizer's model alone is asked, without its search for pieces."""
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    raw = "".join(words).encode()
    mapped, ids_of, id_of = raw.decode("latin-1").translate(_CHARS), tokenizer.model.tokenize, attrgetter("id")
    ids: list[int] = []
    ends, at = [0], 0
    for word in words:
        end = at + (len(word) if word.isascii() else len(word.encode()))
        if word in specials:
            ids.append(specials[word])
        else:
            ids.extend(map(id_of, ids_of(mapped[at:end])))
        ends.append(len(ids))
        at = end
    return np.diff(ends).astype(np.int32), np.array(ids, np.int32)


def encode_words(tokenizer: Tokenizer, words: list[str]) -> list[list[int]]:
    lengths, ids = encoded(tokenizer, words)
    ends, flat = np.cumsum(lengths).tolist(), ids.tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def vocabulary(path: str) -> list[bytes]:
    """The bytes that each id stands for; a table of the tokenizer's own, fixed size."""
    tokenizer = Tokenizer.from_file(path)
    specials = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    alphabet = byte_of_char()
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return [
        specials[i] if i in specials else bytes(alphabet[c] for c in tokenizer.id_to_token(i)) for i in range(size)
    ]


def packed(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all values) of lists of ids."""
    lengths = np.fromiter(map(len, lists), np.int32, len(lists))
    return lengths, np.fromiter((x for own in lists for x in own), np.int32, int(lengths.sum()))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of the lists of such lengths begins among all values."""
    return np.cumsum(lengths, dtype=np.int64) - lengths


def gathered(
    codes: np.ndarray, lengths: np.ndarray, values: np.ndarray, first: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of the lists that the codes name, one after the other. ``first`` is
    ``starts_of(lengths)``, for callers that gather from the same lists many times."""
    own = lengths[codes].astype(np.int64)
    starts = (starts_of(lengths) if first is None else first)[codes]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - own), own)
    return own, values[at]


def shrunk(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers as one compressed value. The lowest bytes of all numbers come
    first, then the next ones: small numbers leave long stretches of zeros."""
    head = np.array([len(a) for a in arrays], "<i4").tobytes()
    body = np.concatenate([np.asarray(a).astype("<i4") for a in arrays])
    raw = head + body.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True)


def grown(value: bytes, n: int) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    sizes = np.frombuffer(raw, "<i4", n)
    body = np.frombuffer(raw, np.uint8, offset=4 * n).reshape(4, -1).T
    return np.split(np.ascontiguousarray(body).view("<i4").ravel(), np.cumsum(sizes)[:-1])
