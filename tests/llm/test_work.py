"""How much work the operators do: rows of joins, files left behind, words split many texts at a time."""

import os
import random
import time

import numpy as np
import pytest
from test_pairs import expected
from test_tokens import PATH, TEXTS, odd_texts
from tokenizers import Tokenizer

from dwellkit.llm import buckets, line_edit, minhash, repair, store, string_svm, winnow
from dwellkit.llm.pretokens import Splitter, distinct, encode_words, encoded
from dwellkit.llm.store import numbered, stored
from dwellkit.llm.text import WordHashes, shingle_set
from dwellkit.session import shared_dir


@pytest.fixture
def pairs_compared(monkeypatch):
    """Rows of the tables of pairs whose texts are compared."""
    counts = []

    def counted(df, purpose):
        out = stored(df, purpose)
        if purpose == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(buckets, "stored", counted)
    return counts


def test_pairs_just_below_the_similarity_are_not_compared(spark, pairs_compared):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for doc in range(150):
        own = list(base)
        for at in rng.sample(range(5, 115), 3):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((doc, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected(rows)
    assert sum(pairs_compared) < 3 * len(rows)


def test_lines_that_share_a_part_are_not_compared(spark, pairs_compared):
    rng = random.Random(6)
    start = "a part that all of these lines have in common, "
    lines = [start + "".join(rng.choice("abcdefghijklmnop ") for _ in range(30)) + "." for _ in range(150)]
    rows = [(i, line) for i, line in enumerate([*lines, lines[3][:-2] + "q."])]
    got = line_edit.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got if r.removed} == {150: [0]}
    assert sum(pairs_compared) < 3 * len(rows)


def test_sketches_lose_no_link():
    rng, hashes = random.Random(2), WordHashes()
    bits = lambda x, y: sum(bin(int(a) & (2**64 - 1) ^ int(b) & (2**64 - 1)).count("1") for a, b in zip(x, y))
    for _ in range(300):
        words = [f"w{rng.randrange(300)}".encode() for _ in range(rng.randrange(1, 200))]
        other = [w if rng.random() > 0.03 else b"new%d" % rng.randrange(50) for w in words]
        a, b = (shingle_set(hashes.of(x), 4) for x in (words, other))
        both = len(np.intersect1d(a, b))
        assert bits(minhash.parity(a), minhash.parity(b)) <= len(a) + len(b) - 2 * both
    for _ in range(300):
        line = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 60)))
        near = line
        for _ in range(2):
            i = rng.randrange(len(near) + 1)
            near = rng.choice([near[:i] + "x" + near[i:], near[:i] + near[i + 1 :], near[:i] + "y" + near[i + 1 :]])
        a, b = line_edit.line_sketch(line), line_edit.line_sketch(near)
        assert bits(a[:1], b[:1]) <= 4 and bits(a[1:], b[1:]) <= 8


def test_a_stored_table_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    out = stored(spark.range(1000).repartition(3, "id"), "kept")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 1000 and out.groupBy("id").count().count() == 1000


def test_words_of_many_texts_are_those_of_each():
    tokenizer = Tokenizer.from_file(PATH)
    splitter, rng = Splitter(tokenizer), random.Random(7)
    texts = [*odd_texts(400), *(t or "" for t in TEXTS), *["'s", "'", "a'", "r", "e", " ", "  ", "\n", ""] * 5]
    for _ in range(100):
        some = rng.sample(texts, rng.randrange(1, 9))
        sizes, words = splitter.words(some)
        assert sizes.tolist() == [len(splitter.split(t)) for t in some]
        assert words.to_pylist() == [w for t in some for w in splitter.split(t)]
        numbers, table = distinct([words.slice(0, 3), words.slice(3)])
        assert len(set(table.to_pylist())) == len(table)
        assert [table[int(i)].as_py() for i in numbers] == words.to_pylist()


def test_ids_of_single_words_are_the_librarys():
    tokenizer = Tokenizer.from_file(PATH)
    splitter = Splitter(tokenizer)
    words = sorted({w for t in [*odd_texts(400), *TEXTS] for w in splitter.split(t or "")})
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert encode_words(tokenizer, words) == want
    lengths, ids = encoded(tokenizer, words)
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_forgotten_words_are_numbered_anew():
    known = repair.WordIds(Tokenizer.from_file(PATH))
    known.of(["one", " two", " three"])
    known.keep(np.array([1, 2]))
    assert known.of([" three", "four", " two"]).tolist() == [1, 2, 0]
    lengths, ids = known.lists()
    want = encode_words(known.tokenizer, [" two", " three", "four"])
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_kernel_rows_of_many_texts_are_those_of_each():
    rng = random.Random(9)
    parts = ["a", "s", "word", "Word.", "stupid!", "i.d", "hello", " ", "\n", "\t\n", "?! ", "...", ". ", "é", "x1y", "s t u p i d "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(25))) for _ in range(120)]
    describe = string_svm.Describer(["stupid", "idiot", "word"])
    for text, rows in zip(texts, describe.texts(texts)):
        sentences = string_svm._sentences(text)
        assert len(rows) == len(sentences)
        for row, words in zip(rows, sentences):
            assert (row == describe.kernel.against(words, describe.table).max(axis=0)).all()


def test_pipeline_stores_a_text_once(spark, monkeypatch):
    import corpus_pipeline

    held = []

    def seen(df, purpose, *name):
        if purpose in ("line-texts", "signed"):
            held.append(df.schema.simpleString().count("text:string"))
        return numbered(df, purpose, *name)

    monkeypatch.setattr(line_edit, "numbered", seen)
    monkeypatch.setattr(minhash, "numbered", seen)
    rows = [(1, "en", "one line of text here\nand ornd.", 31), (2, "en", "and ornd.\nanother text that stays as it is", 0), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long")
    lines = corpus_pipeline.line_dedup(spark, docs, "")
    assert lines.columns == docs.columns
    kept = corpus_pipeline.near_dedup(spark, lines, "")
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()))
    assert got == [(1, "en", rows[0][2], 31), (2, "en", "another text that stays as it is", 32), (3, None, None, None)]
    assert held == [1, 1]


@pytest.fixture
def folders(spark, monkeypatch):
    """Purposes of the stored tables whose folder is still there."""
    made = {}

    def shared(session, purpose):
        path = shared_dir(session, purpose)
        made[path] = purpose
        return path

    monkeypatch.setattr(store, "shared_dir", shared)
    return lambda: sorted(purpose for path, purpose in made.items() if os.path.exists(path))


def test_tables_on_the_way_go(spark, folders):
    def made():
        inner = store.settled(spark, lambda: stored(spark.range(9), "inner").where("id > 3"), "inner-result")
        return stored(inner.where("id > 5"), "outer")

    assert store.settled(spark, made, "result").count() == 3
    assert folders() == ["result"]


def test_only_what_the_rows_need_stays(spark, folders):
    rows = [(i, f"a line that several texts of this test have\n{'one two three four five six seven ' * 3}{i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_edit.deduplicated(docs)
    assert folders() == ["line-texts", "removed-lines"]
    near = minhash.near_duplicates(docs)
    assert folders() == ["line-texts", "removed-lines", "signed", "together"]
    assert sum(len(r.removed) for r in lines.collect()) == 8 + 8 and sum(r.kept for r in near.collect()) == 1


def test_only_related_lines_are_ranked(spark, monkeypatch):
    counts = {}

    def counted(df, purpose):
        out = stored(df, purpose)
        counts[purpose] = out.count()
        return out

    monkeypatch.setattr(line_edit, "stored", counted)
    rng = random.Random(8)
    alone = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(50)) for _ in range(60)]
    rows = [(i, x) for i, x in enumerate([*alone, "the same line of text comes here again", "the same line of text comes here again", alone[0][:-1] + "Z"])]
    got = line_edit.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got if r.removed} == {61: [0], 62: [0]}
    assert counts == {"related-lines": 3, "related-places": 4}


def test_hashes_of_many_lines_are_those_of_each():
    rng = random.Random(3)
    for length in (16, 33, 40):
        lines = ["".join(rng.choice("abé😀 ") for _ in range(length)) for _ in range(20)] + ["a" * length]
        places = line_edit.places_of(length, 2, 32, True)
        keys, sizes = line_edit.hashed(lines, places)
        at = np.append(0, np.cumsum(sizes))
        for i, line in enumerate(lines):
            own = keys[at[i] : at[i + 1]].tolist()
            assert own == line_edit.keys_of(line, 2, 32, True) and len(set(own)) == len(own)
            assert len(own) == len({(line[a:b], seed) for a, b, seed in places})


def test_texts_without_a_hit_meet_nothing(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "four five")], "item_id string, text string")
    out = winnow.contamination(docs, items)
    assert sorted((r.doc_id, r.n_hit) for r in out.collect()) == [(1, 0), (2, 2)]
    plan = out._jdf.queryExecution().sparkPlan()
    while plan.nodeName() != "Union":
        plan = plan.children().apply(0)
    joins = ["Join" in plan.children().apply(i).toString() for i in range(plan.children().size())]
    assert joins == [False, True]


def test_words_that_came_again_are_remembered(monkeypatch):
    describe, looked = string_svm.Describer(["stupid", "idiot", "word"], most=30), []
    against = string_svm.Kernel.against
    monkeypatch.setattr(string_svm.Kernel, "against", lambda self, words, table: looked.extend(words) or against(self, words, table))
    rng = random.Random(5)
    new = ["".join(rng.choice("stupidow") for _ in range(9)) for _ in range(80)]
    texts = [f"again {' '.join(new[:40])} again.", f"again {' '.join(new[40:])} again", "again and once more s t u p i d"]
    for text in texts:
        rows, sentences = describe.texts([text])[0], string_svm._sentences(text)
        assert [list(r) for r in rows] == [list(against(describe.kernel, s, describe.table).max(axis=0)) for s in sentences]
    assert looked.count("again") == 1


def test_a_very_long_sentence_is_whole():
    describe, rng = string_svm.Describer(["stupid", "idiot", "word"]), random.Random(6)
    words = ["".join(rng.choice("stupidow") for _ in range(7)) for _ in range(string_svm.PART + 2 * string_svm.LONG)]
    for text in (" ".join(words), " ".join(words[: string_svm.LONG]) + ". " + " ".join(words)):
        rows, sentences = describe.texts([text])[0], string_svm._sentences(text)
        assert len(rows) == len(sentences)
        for row, own in zip(rows, sentences):
            assert (row == describe.kernel.against(own, describe.table).max(axis=0)).all()
