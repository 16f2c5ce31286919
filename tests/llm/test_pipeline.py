"""The stages of corpus_pipeline on a small corpus with planted cases and odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dwellkit.llm import line_edit, minhash, perplexity, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["tion", "er", "ing", "the", "ou", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    rows = []
    for doc in range(40):
        text = "\n".join(sentence(rng, 30) for _ in range(4))
        rows.append((doc, text, "en", "src0", len(text)))
    item = sentence(rng, 25)
    rows[30] = (30, rows[30][1] + "\n" + item, "en", None, None)  # contaminated
    words = rows[5][1].replace("\n", " ").split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows[31] = (31, near, "en", "src0", len(near))  # near copy on one line of its own
    rows[32] = (32, rows[6][1], "en", "src0", rows[6][4])  # exact copy
    edited = rows[7][1].split("\n")[0][:-1] + "x"
    rows[33] = (33, rows[33][1] + "\n" + edited, "en", "src0", 0)  # one line nearly repeats
    odd = [(50, None, None, None, None), (51, "", "en", "s", 0), (None, rows[8][1] + " odd end", "en", "s", 1), (52, "a b " * 200, "en", "s", 1)]
    return rows + odd + [rows[9]], [(1, item), (2, None), (3, "")]


def test_stages_do_what_they_say(spark, corpus, tmp_path):
    rows, items = corpus
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", digest int, whole_row int")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = corpus_pipeline.stored(kept, "test-stage")
        seen[name] = kept.collect()
    after = {name: sorted(str(r.doc_id) for r in found) for name, found in seen.items()}
    clean = {str(i) for i in range(40)} - {"30", "31", "32"}
    assert clean | {"30", "31", "32", "None"} == set(after["quality rules"])
    assert "32" not in after["line dedup"] and clean <= set(after["line dedup"])
    texts = {r.doc_id: r for r in seen["line dedup"]}
    assert texts[33].text == rows[33][1].rsplit("\n", 1)[0] and texts[33].n_chars == len(texts[33].text)
    assert texts[5].text == rows[5][1] and texts[30].n_chars is None
    assert "31" not in after["minhash near-dedup"] and clean <= set(after["minhash near-dedup"])
    assert after["minhash near-dedup"].count("9") == 1
    assert after["benchmark decontamination"] == sorted(set(after["minhash near-dedup"]) - {"30"})
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_id = {r.doc_id: r for r in last}
    for r in seen["benchmark decontamination"]:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert by_id[r.doc_id].n_tokens == len(ids)
        assert by_id[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_equals_its_stages(spark, corpus, tmp_path):
    rows, items = corpus
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    ids = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert len(ids) == len(set(ids)) and {str(i) for i in range(30)} <= set(ids)
    assert not {"30", "31", "32", "50", "51", "52"} & set(ids)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_operators_read_only_what_they_name(spark):
    df = spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, lang int")
    assert minhash.near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id", "kept", "first"]
    assert line_edit.deduplicated(df).columns == ["doc_id", "text", "n_lines", "removed"]
    assert perplexity.quality(df).first().base_failed
    items = spark.createDataFrame([(1, "z")], "item_id long, text string")
    assert not winnow.contamination(df, items).first().contaminated
