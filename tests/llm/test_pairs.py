"""MinHash near-dedup and line dedup against brute force."""

import random

import numpy as np
import pytest

from dwellkit.llm import buckets, line_edit, minhash
from dwellkit.llm.text import LOWER, WordHashes, shingle_set


def shingles(text, n):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def expected(rows, n=4, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    root = roots(len(rows), links)
    least = {}
    for (doc, _), r in zip(rows, root):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(
        (str(doc), len(s), str(least.get(r)) if s else str(doc)) for (doc, _), s, r in zip(rows, sets, root)
    )


def corpus(seed=3, groups=12, copies=9, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for c in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((doc, " ".join(own).upper() if c % 3 else "\n".join(own)))
            doc += 1
    return rows


ODD = [(900, ""), (901, None), (902, " \n\t"), (903, "one two"), (904, "One  TWO"), (None, "one two"), (903, "one two")]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus() + ODD
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = minhash.near_duplicates(df, words=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected(rows)
    for r in got:
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    by_component = {}
    for r in got:
        if r.n_shingles:
            by_component.setdefault(r.component_id, []).append(r.first)
    assert all(sum(v) == 1 for v in by_component.values())


def test_hot_group_of_different_texts(spark):
    """One base with many variants, more than a hub of each bucket can settle."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for doc in range(220):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((doc, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == expected(rows)


def test_heavy_keys_take_the_grouped_way_and_give_the_same(spark, monkeypatch):
    rows = [(k, n, n % 3) for n in range(300) for k in ({n % 7, 100 + n % 50, 1000 + n})]
    entries = spark.createDataFrame(rows, "key long, node long, size long")
    plain = sorted(map(tuple, buckets.members_of(entries).collect()))
    monkeypatch.setattr(buckets, "HEAVY_ROWS", 5)
    monkeypatch.setattr(buckets, "HEAVY", 1)
    assert sorted(map(tuple, buckets.members_of(entries).collect())) == plain
    by_key = {}
    for k, n, s in rows:
        by_key.setdefault(k, []).append((n, s))
    want = sorted((k, n, s, *min(v)) for k, v in by_key.items() if len(v) > 1 for n, s in v)
    assert plain == want


def test_empty_documents_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert minhash.near_duplicates(df).collect() == []
    assert line_edit.deduplicated(df).collect() == []


def test_signature_estimates_similarity():
    hashes, ranks = WordHashes(), minhash.ring()
    words = [f"v{i}".encode() for i in range(1000)]
    a = shingle_set(hashes.of(words[:800]), 5)
    b = shingle_set(hashes.of(words[100:900]), 5)
    both = len(np.intersect1d(a, b))
    true = both / (len(a) + len(b) - both)
    share = (minhash.signature(a, ranks) == minhash.signature(b, ranks)).mean()
    assert abs(share - true) < 0.08


# Lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(rng, line, n, letters="abc "):
    for _ in range(n):
        i = rng.randrange(len(line) + 1)
        line = rng.choice([line[:i] + rng.choice(letters) + line[i:], line[:i] + line[i + 1 :], line[:i] + rng.choice(letters) + line[i + 1 :]])
    return line


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_within_equals_edit_distance(threshold):
    rng = random.Random(threshold)
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        b = edited(rng, a, rng.randrange(5), "abé")
        assert line_edit.within(a, b, threshold) == (distance(a, b) <= threshold), (a, b)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_close_lines_share_a_key(threshold):
    rng = random.Random(threshold)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(8, 30)))
        b = edited(rng, a, rng.randrange(threshold + 1), "ab")
        if min(len(a), len(b)) >= 6 and distance(a, b) <= threshold:
            assert set(line_edit.keys_of(a, threshold, 6)) & set(line_edit.keys_of(b, threshold, 6))


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(40)).strip().ljust(36, "z") for _ in range(25)]
    docs = []
    for doc in range(60):
        lines = [edited(rng, rng.choice(bases), rng.randrange(4)) for _ in range(rng.randrange(5))]
        lines += rng.choice([[], ["short"], ["short", ""], ["  "]])
        docs.append((doc, "\n".join(lines)))
    docs += [(100, None), (101, ""), (7, docs[7][1]), (None, docs[9][1])]
    got = line_edit.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    flat = [
        (i, n, line_edit.normalised(x))
        for i in order
        for n, x in enumerate((docs[i][1] or "").split("\n"))
        if len(line_edit.normalised(x)) >= 32
    ]
    links = [
        (i, j)
        for i in range(len(flat))
        for j in range(i)
        if abs(len(flat[i][2]) - len(flat[j][2])) <= 2 and distance(flat[i][2], flat[j][2]) <= 2
    ]
    root = roots(len(flat), links)
    gone = {}
    for k, r in enumerate(root):
        if r != k:
            gone.setdefault(flat[k][0], set()).add(flat[k][1])
    want = []
    for i, (doc, text) in enumerate(docs):
        lines = (text or "").split("\n")
        kept = text if not gone.get(i) else "\n".join(x for n, x in enumerate(lines) if n not in gone[i])
        want.append((str(doc), str(kept), len(lines) if text is not None else 0, sorted(gone.get(i, ()))))
    assert sorted((str(r.doc_id), str(r.text), r.n_lines, r.removed) for r in got) == sorted(want)


def test_short_lines_have_a_threshold_of_their_length(spark):
    a = "all rights reserved."
    docs = [(1, f"{a}\nand ornd.\n\n{'x' * 31}"), (2, f"{a.upper()}\nand ornd.\n\n{'x' * 32}"), (3, f"{a[:-1]}!\nand orne.\n{a[1:]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_edit.deduplicated(df, short=True).collect()}
    assert got == {1: [], 2: [0, 1, 3], 3: [0, 2]}  # "orne" is too short for an edit


def test_registered_query_takes_short_lines_out(spark, tmp_path):
    from dwellkit.llm.queries import QUERIES

    docs = [(1, "and ornd.\nown"), (2, "and ornd.\nother")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.removed for r in QUERIES["op2_line_edit_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "0"}
