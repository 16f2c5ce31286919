"""URL cascade, chat events and the string kernel against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellkit.llm import chat_events, string_svm, url_cascade
from dwellkit.llm.queries import RULES


def slow_verdict(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    labels = host.split(".")
    blocked = bool(host) and any(".".join(labels[i:]) in listed for i in range(len(labels)))
    return host, path, best and best[1] + best[2], best[0] if best else "block" if blocked else "allow"


@pytest.mark.parametrize("rate,most", [(1 / 32, 1 << 20), (0.5, 1 << 20), (0.5, 0)])
def test_verdicts_equal_brute_force(spark, rate, most):
    rng = random.Random(2)
    names = [f"{rng.choice(['', 'www.', 'M.'])}site{i}.{rng.choice(['com', 'net', 'org', 'example.org'])}" for i in range(400)]
    listed = {n.lower() for n in names[:120:2]} | {"site7.net", "nowhere.net"}
    urls = [f"http://{n}{rng.choice(['', '/', '/fr/x', '/de/y?q#z', '/es/', '/en/1', '#a/b', '?a://b'])}" for n in names]
    urls += [None, "", "no scheme", "://", "x://HOST/Ä", "ftp://a.b/c://d", "http://org", "http://com/fr/", "http:///p"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    blocks = spark.createDataFrame([(x,) for x in listed] + [(None,)], "domain string")
    got = url_cascade.judge(pages, blocks, RULES, pass_rate=rate, most_words=most).collect()
    want = [(i, *slow_verdict(u, listed)) for i, u in enumerate(urls * 2)]
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want


def test_levels_are_needed_and_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    cascade = url_cascade.build_cascade(universe, 0.5)
    assert len(cascade.levels) > 3
    told = universe.select("listed", url_cascade.is_listed(F.col("key"), cascade).alias("found"))
    assert told.where("listed <> found").count() == 0


def test_no_pages_and_no_list(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    empty = spark.createDataFrame([], "domain string")
    assert [r.verdict for r in url_cascade.judge(pages, empty, RULES).collect()] == ["allow"]
    assert url_cascade.judge(pages.limit(0), empty, RULES).collect() == []


# Chats


def slow_fold(events):
    order = sorted(events, key=lambda e: (e[1], e[2], -1 if e[3] is None else e[3], e[4] or "", e[5] or ""))
    turns: dict = {}
    for _, _, kind, turn, role, text in order:
        at = -1 if turn is None else turn
        if kind == "regenerate":
            turns = {t: v for t, v in turns.items() if t < at}
        elif kind == "delete":
            turns.pop(at, None)
        elif kind in ("message", "edit"):
            old = turns.get(at, (None, ""))
            turns[at] = (role if kind == "message" else role or old[0], text or "")
        elif kind == "delta":
            old = turns.get(at, (None, ""))
            turns[at] = (role or old[0], old[1] + (text or ""))
    return turns


def test_fold_equals_replay(spark):
    rng = random.Random(9)
    events = []
    for conv in [*range(30), None]:
        for seq in range(rng.randrange(14)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete", "ping"])
            role = rng.choice(["user", "assistant", None]) if kind in ("message", "edit", "delta") else None
            events.append((conv, seq, kind, rng.choice([None, 0, 1, 2]), role, rng.choice(["x", "<|im_end|>", None, "é\n"])))
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = defaultdict(dict)
    for r in chat_events.fold(df).collect():
        got[r.conv_id][-1 if r.turn is None else r.turn] = (r.role, r.text)
    for conv in [*range(30), None]:
        assert got.get(conv, {}) == slow_fold([e for e in events if e[0] == conv]), conv


TURNS = [
    (1, 0, "user", "hi <|im_end|>\\<|"),
    (1, 1, "assistant", "<|im_start|>assistant\nok\\"),
    (1, 2, "assistant", None),
    (2, 0, "sys\ntem<|", "é" * 50),
    (2, 0, "user", "same turn"),
    (3, None, None, ""),
    (None, 4, "assistant", "\\n <\\| <|<||"),
]


def test_format_reads_back(spark):
    df = spark.createDataFrame([(*t, 0) for t in TURNS], "conv_id long, turn long, role string, text string, start int")
    formatted = chat_events.render(chat_events.fold(chat_events.events_of(df)))
    for r in formatted.collect():
        assert r.formatted.count("<|") == 2
    got = {r.conv_id: r for r in chat_events.read_back(formatted).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] or -1, t[2] or "", t[3] or ""))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(x.formatted) for x in formatted.where(F.col("conv_id").eqNullSafe(conv)).collect())


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_events.read_back(chat_events.render(chat_events.fold(chat_events.events_of(none)))).collect() == []


# Toxicity


def slow_kernel(s, t):
    def features(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    out[w[i] + w[j] + w[k]] += string_svm.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    norm = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
    return sum(v * b[u] for u, v in a.items() if u in b) / norm**0.5


def test_kernel_equals_definition():
    words = ["idiot", "idxiot", "ixdixoxt", "aaaa", "banana", "worthless", "lsr", "étéété"]
    kernel = string_svm.Kernel()
    got = kernel.against(words, kernel.table(words))
    want = np.array([[slow_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    assert got[1, 0] > 0.5 > got[5, 0]


def test_letters_between_and_apart():
    assert string_svm.words_of("i d i o t you id*i*ot") == ["idiot", "you", "idiot"]
    assert string_svm.words_of("a b") == []


def toxic_docs(seed=1, n=400):
    rng = random.Random(seed)
    parts = ["tion", "er", "ing", "the", "ou", "st", "re"]
    insults = ["idiot", "loser", "moron", "worthless"]
    rows = []
    for doc in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 60))]
        label = int(rng.random() < 0.3)
        for _ in range(2 * label):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        for i in range(7, len(words), 8):
            words[i] += "."
        rows.append((doc, " ".join(words), label))
    return rows


def test_held_out_accuracy_and_disguises(spark):
    rows = toxic_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    held = string_svm.held_out(F.col("doc_id"))
    model = string_svm.fit(df.where(~held), rows=1000)
    got = {r.doc_id: r.predicted for r in string_svm.score(df.where(held), model).collect()}
    right = [got[d] == y for d, _, y in rows if d in got]
    assert np.mean(right) > 0.95
    odd = [
        (1, "the ing you i.d.i.o.t of tion"),
        (2, "the ing you idxiot of tion"),
        (3, "the ing you l o s e r of tion"),
        (4, "the ing you of tion"),
        (5, ""),
        (6, None),
        (None, "!!! ..."),
        (7, "er" * 5000),
    ]
    scores = {r.doc_id: r for r in string_svm.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert [scores[i].predicted for i in (1, 2, 3)] == [1, 1, 1]
    assert [scores[i].predicted for i in (4, 5, 6, None, 7)] == [0] * 5
    assert all(0 <= r.score <= 1 for r in scores.values())


def test_one_label_alone_predicts_nothing(spark):
    df = spark.createDataFrame([(1, "some words", 0), (2, None, 0), (3, "x", None)], "doc_id long, text string, label int")
    model = string_svm.fit(df)
    assert [r.predicted for r in string_svm.score(df, model).collect()] == [0, 0, 0]


def test_every_clean_sentence_of_the_sample_is_trained_on(spark):
    rows = toxic_docs(seed=2, n=120)
    milder = [(d, t if y else t + 30 * (" " + t.split(".")[0] + "."), y) for d, t, y in rows]
    schema = "doc_id long, text string, label int"
    few, many = (string_svm.fit(spark.createDataFrame(r, schema), rows=1000) for r in (rows, milder))
    assert few.landmarks == many.landmarks
    assert not np.allclose(few.weights, many.weights, rtol=1e-3)


def test_logistic_does_not_overshoot():
    x = np.concatenate([np.full(900, -1.0), np.full(100, 0.4)])
    y = (x > 0).astype(float)
    for shift in (0.0, -6.0, 6.0, -12.0):
        a, b = string_svm._logistic(x + shift, y)
        assert np.mean((a * (x + shift) + b > 0) == (y == 1)) == 1
