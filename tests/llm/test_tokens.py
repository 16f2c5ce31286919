"""Words, ids and grammar files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dwellkit.llm import bpe_words, repair
from dwellkit.llm.pretokens import Splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "Hello world's  end,\n\n we'll  see'd 'tis 123abc ''s x'",
    "  lead and trail  ",
    " 's'ts 're'veil'llama",
    "a\t b c d 　e",
    "naïve café 東京 ١٢٣ ²³ Ⅷ 🙂🙂 é",
    "<|endoftext|> stop<|endoftext|><|endoftext|>",
    "<|endoftext|>x " * 3000,
    "�\x00\x1f",
    "!!!... --- \"'quoted'\" don't DON'T",
    "",
    None,
    "x" * 3000 + " " * 200 + "y",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def odd_texts(n=300):
    rng = random.Random(1)
    signs = ["a", "Z", "é", "東", "1", "²", "'", "s", "t", "re", " ", "  ", "\n", "\t", " ", "!", "🙂", "՘", "㿃b"[:1], "́", "<|", "ll"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_words_are_the_librarys(tokenizer):
    splitter = Splitter(tokenizer)
    for text in [*filter(None, TEXTS), *odd_texts()]:
        if "<|endoftext|>" not in text:
            assert splitter.split(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)], repr(text)


def test_ids_and_text_come_back(spark, tokenizer):
    rows = [(i if i else None, t) for i, t in enumerate([*TEXTS, *odd_texts(60)])] + [(1, "twice"), (1, "twice")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, ids string")
    got = bpe_words.digests(df, PATH).collect()
    want = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want.append((str(doc), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    encoded = bpe_words.encode(df, PATH)
    texts = {(str(r.doc_id), r.text) for r in bpe_words.decode(encoded, PATH).collect()}
    assert texts == {(str(d), t or "") for d, t in rows}


def test_several_blocks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_words, "BLOCK_WORDS", 50)
    rows = [(i, t) for i, t in enumerate(odd_texts(200))]
    got = bpe_words.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {r.doc_id: r.ids for r in got} == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_broken_characters_decode_as_the_library_does(spark, tokenizer):
    ids = [tokenizer.encode("東", add_special_tokens=False).ids[0], 35, 50256]
    df = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe_words.decode(df, PATH).collect()}
    assert got == {1: tokenizer.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_no_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_words.digests(df, PATH).collect() == []
    repair.write(df, str(tmp_path / "none"), PATH)
    assert repair.read_digests(repair.read(spark, str(tmp_path / "none")), repair.symbols_of(PATH)).collect() == []


# Re-Pair


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, 5, 4000) if seed else np.zeros(1000, np.int64)
    seq[rng.integers(0, len(seq), 20)] = repair.END_OF_DOC
    rules, short = repair.compress(seq, 10, least=2)
    assert len(short) < len(seq)
    assert (repair.expand(short, rules, 10) == seq).all()
    sizes = repair.expansion_lengths(rules, 10)
    for i, n in enumerate(sizes):
        assert n == len(repair.expand(np.array([10 + i]), rules, 10))


def test_words_share_rules():
    words = [[1, 2, 3], [1, 2], [2, 3], [4], []] * 3
    rules, short = repair.word_grammar(words, np.arange(1, 16), 10, least=2)
    assert len(short) == len(words)
    assert [repair.expand(s, rules, 10).tolist() for s in short] == words
    assert sum(map(len, short)) < sum(map(len, words))


def test_files_hold_every_document(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 400)
    rng = random.Random(3)
    rows = [(i * 3, t) for i, t in enumerate([*TEXTS, *odd_texts(120)])]
    rows += [(1, " ".join(rng.choice(["tick", "tock", "tack"]) for _ in range(400)))]
    rng.shuffle(rows)
    path = str(tmp_path / "ids")
    repair.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, PATH, end_id=2)
    files, n_ids = repair.read(spark, path), repair.symbols_of(PATH)
    assert files.count() > 3
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.read_digests(files, n_ids).collect()}
    at, want, ids_of = 0, {}, {}
    for doc, text in sorted(rows):
        ids_of[doc] = ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    for shard in files.collect():
        for i, doc in enumerate(shard.doc_ids):
            assert repair.document(shard.asDict(), i, n_ids).tolist() == ids_of[doc]


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(5, "b"), (5, "b"), (None, "a"), (5, None)]
    path = str(tmp_path / "odd")
    repair.write(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH)
    got = repair.read_digests(repair.read(spark, path), repair.symbols_of(PATH)).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got) == [(0, None, 2), (2, 5, 1), (3, 5, 2), (5, 5, 2)]
