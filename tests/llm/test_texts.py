"""Winnowing, unit hashing and quality rules against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dwellkit.llm import perplexity, unit_hash, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items):
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, names = set(), set()
        for item, t in items:
            x = plain_words(t)
            n = min(10, len(x))
            if not n:
                continue
            grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
            found = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams]
            hit |= {i + j for i in found for j in range(n)}
            if found and item is not None:
                names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out)


def test_winnowing_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "b", "c", "é", "dd", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 9, 10, 11, 14, 40])))) for i in range(30)]
    items += [(40, None), (41, "  ..."), (1, items[5][1]), (None, items[6][1]), (42, "unique token")]
    docs = []
    for doc in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            x = plain_words(rng.choice(items)[1])
            at, cut = rng.randrange(len(w) + 1), rng.randrange(len(x) + 1)
            w[at:at] = x[cut : cut + rng.randrange(5, 30)]
        docs.append((doc, rng.choice([" ", ", ", "\n"]).join(w).upper()))
    docs += [(100, None), (101, ""), (102, "Unique, TOKEN!"), (3, docs[3][1]), (None, docs[4][1])]
    frames = (
        spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_hit int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    got = winnow.contamination(*frames).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert rows == contaminated(docs, items)


def test_winnowing_empty_sides(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in winnow.contamination(docs, none).collect()] == [False]
    assert winnow.contamination(docs.limit(0), none).collect() == []


def test_every_shared_span_keeps_a_hash():
    rng = np.random.default_rng(1)
    for _ in range(300):
        span = rng.integers(0, 4, 10).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64), span])
        b = np.concatenate([span, rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)])
        keys = [set(winnow.grams(x, winnow.K)[winnow.fingerprints(x)].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


# Units


def test_units_equal_brute_force(spark):
    rng = random.Random(6)
    said = [" ".join(rng.choice(["tree", "Lake", "of", "the", "sky"]) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    docs = []
    for doc in range(70):
        docs.append((doc, "".join(rng.choice(said) + rng.choice([". ", "! ", ".\n", "\n", "? "]) for _ in range(rng.randrange(9)))))
    docs += [(200, None), (201, ""), (202, "\n\n . "), (9, docs[9][1]), (None, docs[11][1])]
    got = unit_hash.repeated_units(spark.createDataFrame([(t, d, "q") for d, t in docs], "text string, doc_id long, start string"))
    places = []
    for i, (doc, text) in enumerate(docs):
        for m in re.finditer(r"(?:[^.!?\n]|[.!?](?![ \n]|$))+[.!?]*", text or ""):
            words = re.findall(r"\w+", m.group().lower())
            if len(words) >= 6:
                lead = len(m.group()) - len(m.group().lstrip())
                places.append(((doc is None, doc or 0, i, m.start() + lead), " ".join(words), doc))
    places.sort(key=lambda p: p[0])
    first, want = {}, []
    for rank, words, doc in places:
        if words in first:
            want.append((str(doc), rank[3], str(first[words][1]), first[words][0][3]))
        else:
            first[words] = (rank, doc)
    rows = got.collect()
    assert sorted((str(r.doc_id), r.start, str(r.first_doc_id), r.first_start) for r in rows) == sorted(want)
    texts = {d: t for d, t in docs if d is not None}
    for r in rows:
        if r.doc_id is not None:
            own, other = texts[r.doc_id][r.start : r.end], texts[r.first_doc_id][r.first_start :]
            assert unit_hash.normalised(other).startswith(unit_hash.normalised(own))


def test_runs_of_units(spark):
    passage = ["one two three four.", "Five six.", "Seven eight nine ten."]
    docs = [
        (1, " ".join(passage)),
        (2, "Own start of " + " ".join(passage) + " Own end."),  # its first sentence is another
        (3, "Own. Five six. Own words here."),
        (4, "Five six. Seven eight nine ten. x. one two three four. Five six."),
        (2, " ".join(passage)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = unit_hash.repeated_units(df, min_words=1, min_run_words=6).collect()
    texts = [t for _, t in docs]
    found = sorted((r.doc_id, r.start, texts[4 if r.start in (0, 20, 30) and r.doc_id == 2 else r.doc_id - 1][r.start : r.end]) for r in got)
    assert [f[2] for f in found if f[0] == 4] == ["Five six.", "Seven eight nine ten.", "one two three four.", "Five six."]
    assert {f[0] for f in found} == {2, 4}
    assert sum(f[0] == 2 for f in found) == 5


@pytest.mark.parametrize("kind", ["line", "paragraph", "sentence"])
def test_unit_offsets_lie_in_the_text(kind):
    text = " One two. Three\n\n  four five!\n \nSix  "
    cut = [text[a:b] for a, b in unit_hash.units(text, kind)]
    assert all(x == x.strip() and x for x in cut)
    assert "".join("".join(cut).split()) == "".join(text.split())
    assert unit_hash.without_spans(text, list(unit_hash.units(text, kind))).strip() == ""


# Quality


def slow_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)]


def slow_model(docs, order=perplexity.ORDER):
    """Modified Kneser-Ney by dictionaries: lang -> function of an n-gram."""
    words = defaultdict(Counter)
    for text, lang in docs:
        for w in (text or "").encode().split():
            for part in perplexity.parts(w.decode()):
                words[lang or ""][part] += 1
    out = {}
    for lang, counts in words.items():
        top = Counter()
        for w, n in counts.items():
            for g in perplexity.word_grams(w):
                top[g] += n
        tables = {order: top}
        for k in range(order - 1, 0, -1):
            tables[k] = Counter(g[1:] for g in tables[k + 1])

        def p(g, tables=tables):
            k = len(g)
            t = tables[k]
            n = Counter(t.values())
            d = [0.5, 1.0, 1.5]
            if all(n[i] for i in (1, 2, 3)):
                y = n[1] / (n[1] + 2 * n[2])
                raw = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
                if all(0 < x <= i for i, x in zip((1, 2, 3), raw)):
                    d = raw
            own = {x: c for x, c in t.items() if x[:-1] == g[:-1]}
            total = sum(own.values())
            gamma = sum(min(d[min(c, 3) - 1], c) for c in own.values()) / total
            below = p(g[1:], tables) if k > 1 else 1 / (len(own) + 1)
            return max(t[g] - d[min(t[g], 3) - 1], 0) / total + gamma * below

        out[lang] = p
    return out


def texts(seed=2, n=40):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "er", "on", "st"], "fr": ["eau", "é", "ai", "tion"], None: ["zz", "yx"]}
    rows = []
    for doc in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(40, 90))]
        rows.append((doc, rng.choice([" ", "\n", " # "]).join(words), lang))
    return rows + [(90, None, "en"), (91, "", "en"), (92, "a b c " * 30, "en"), (93, "x" * 500, "fr"), (3, rows[3][1], rows[3][2])]


def test_quality_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, x, 1) for d, t, x in rows], "doc_id long, text string, lang string, symbols int")
    got = perplexity.quality(df).collect()
    whole = perplexity.quality(df, most_entries=0).collect()  # the way of a model too large for a task
    model = slow_model([(t, x) for _, t, x in rows])
    want = []
    for doc, text, lang in rows:
        grams = [g for w in (text or "").encode().split() for g in perplexity.word_grams(w.decode())]
        logp = sum(math.log(model[lang or ""](g)) for g in grams)
        want.append((doc, *slow_features(text), -logp / len(grams) if grams else None))
    key = lambda r: (r[0], r[1])
    for rows_ in (got, whole):
        have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.log_perplexity) for r in rows_]
        for a, b in zip(sorted(have, key=key), sorted(want, key=key)):
            assert a[:-1] == b[:-1]
            assert a[-1] == pytest.approx(b[-1], rel=1e-4) if b[-1] is not None else a[-1] is None
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.low <= r.log_perplexity <= r.high)


def test_unseen_words_back_off(spark):
    text = "there other then hen"
    arrays = perplexity.in_memory(perplexity.fit(spark.createDataFrame([(text, "en")], "text string, lang string")))["en"]
    words = [b"then", b"thex", "éé".encode()]
    rates = [x / (len(w.decode()) + 1) for w, x in zip(words, perplexity.score_words(arrays, words))]
    assert 0 > rates[0] > rates[1] > rates[2] > -20
    assert perplexity.score_words(None, [b"then"])[0] == pytest.approx(5 * perplexity.UNKNOWN)


def test_probabilities_sum_to_one(spark):
    text = "there other then hen the tree three hero"
    arrays = perplexity.in_memory(perplexity.fit(spark.createDataFrame([(text, "en")], "text string, lang string")))["en"]
    letters = set(text) | {"Q"}  # one stands for every new character
    for context in ("  ", "th", "qq", "er"):
        keys = np.array([perplexity.number_of(context + c) for c in letters])
        assert np.exp(arrays.log_p(keys)).sum() == pytest.approx(1.0, abs=1e-4)


def test_quality_of_an_empty_table(spark):
    assert perplexity.quality(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_four_characters_are_told_apart(spark):
    text = "abcx dbcy " * 20
    arrays = perplexity.in_memory(perplexity.fit(spark.createDataFrame([(text, "en")], "text string, lang string")))["en"]
    seen, crossed = perplexity.score_words(arrays, [b"abcx", b"abcy"])
    assert seen > crossed + 2  # of three characters, both are "bcx" and "bcy" behind "abc"


def test_characters_that_share_a_number_are_joined(spark):
    df = spark.createDataFrame([(1, "a\U0001f600b a\uf600c " * 30, "en")], "doc_id long, text string, lang string")
    assert not perplexity.distinct(perplexity.in_memory(perplexity.fit(df)))
    whole = perplexity.quality(df, most_entries=0).first()
    assert perplexity.quality(df).first().log_perplexity == pytest.approx(whole.log_perplexity, rel=1e-6)


def test_bands_leave_out_the_tails_of_each_language(spark):
    rows = [("en", i / 100) for i in range(200)] + [(None, i / 10) for i in range(20)] + [("fr", None)]
    got = {r.lang: r for r in perplexity.bands(spark.createDataFrame(rows, "lang string, log_perplexity double")).collect()}
    out = lambda lang: [x for own, x in rows if own == lang and x is not None and not got[lang].low <= x <= got[lang].high]
    assert out("en") == [0.0, 0.01, 0.02, 0.03, 1.96, 1.97, 1.98, 1.99]
    assert out(None) == []


def test_marks_around_a_stop_end_a_sentence(spark):
    docs = [(1, "One two was. Three four five. Six seven."), (2, 'own was.*** Three four "five." Six seven?) End')]
    got = unit_hash.repeated_units(spark.createDataFrame(docs, "doc_id long, text string"), min_words=1).collect()
    assert sorted(docs[r.doc_id - 1][1][r.start : r.end] for r in got) == ["Six seven?)", 'Three four "five."']
    assert len(list(unit_hash.units("." * 100_000 + "x", "sentence"))) == 1
