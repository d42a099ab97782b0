"""BPE against tiktoken, the classifier by held-out accuracy, and the pipeline end to end."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA, clashing, sentence

from claimloom.llm import bpe, quality_model

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return bpe.vocabulary()


@pytest.fixture(scope="module")
def oracle(vocabulary):
    data, pattern = vocabulary
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(data), special_tokens={})


def test_codec(vocabulary, oracle):
    codec = bpe.Codec(*vocabulary, max_pieces=50)
    rng = random.Random(1)
    parts = ["ab", "aé ", "  \n", "the", "0123", "日本語😀", " ing ation", "<|endoftext|>", "''s"]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 50)))
        ids = codec.encode(text)
        assert ids == oracle.encode_ordinary(text) and codec.decode(ids) == text


def test_small_state_table(vocabulary):
    data, _ = vocabulary
    small, large = bpe.Transducer(bpe.load_ranks(data), max_states=3, max_pairs=5), bpe.Transducer(bpe.load_ranks(data))
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"aetin hos\xc3\xa9") for _ in range(rng.randint(1, 40)))
        assert small.encode(piece) == large.encode(piece) == ([large.ranks[piece]] if piece in large.ranks else large.merged(piece))


def test_long_piece(vocabulary, oracle):
    codec = bpe.Codec(*vocabulary)
    for text in ("x" * 20000, "ab" * 9000, "日本" * 3000):
        assert codec.encode(text) == oracle.encode_ordinary(text)


def test_utf8_stream():
    rng = random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(rng.randint(0, 14)))
        stream, out, i = bpe.Utf8Stream(), "", 0
        while i < len(data):
            j = i + rng.randint(1, 4)
            out, i = out + stream.feed(data[i:j]), j
        assert out + stream.close() == data.decode("utf-8", "replace")


def test_documents(docs, docs_rows, empty, vocabulary, oracle):
    out = bpe.encode_documents(clashing(docs), *vocabulary).collect()
    expected = []
    for doc_id, text, *_ in docs_rows:
        ids = oracle.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), tuple(ids)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in out) == Counter(expected)
    assert bpe.encode_documents(empty, *vocabulary).count() == 0


def labelled(spark, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = sentence(rng, rng.randint(20, 150))
        rows.append((i, text if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text.split()), "en", "s", 0))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "word " * 20000, "en", "s", 0), rows[3], (None, "text", "en", "s", 0)]
    labels += [(1000, None, 0), (None, 1, 0), (9999, 1, 0), labels[5]]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {a: q for a, q, _ in labels}


def test_classifier(spark):
    docs, labels, truth = labelled(spark)
    out = quality_model.classify(clashing(docs), labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95


def test_classifier_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality_model.classify(docs, none).collect()} == {0.5}
    assert quality_model.classify(empty, none).count() == 0


def test_isotonic():
    y, w = np.array([0.2, 0.1, 0.5, 0.4, 0.9]), np.ones(5)
    assert quality_model.isotonic(y, w).tolist() == pytest.approx([0.15, 0.15, 0.45, 0.45, 0.9])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    items = [(i, sentence(rng, 30)) for i in range(4)]
    clean = [(i, sentence(rng, 200), "en", "s", 0) for i in range(30)]
    rows = clean + [(100, clean[0][1], "en", "s", 0), (101, clean[1][1] + " tail", "en", "s", 0), (102, sentence(rng, 100) + " " + items[0][1] + " " + sentence(rng, 100), "en", "s", 0)]
    rows += [(103, "too short", "en", "s", 0), (104, None, "en", "s", 0), (105, sentence(rng, 150) + ' token = "0123456789abcdef0123456789abcdef" ' + sentence(rng, 50), "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {r[0] for r in clean} | {105}
    codec = bpe.Codec(*bpe.vocabulary())
    assert "[REDACTED]" in codec.decode(out[105]["ids"]) and codec.decode(out[3]["ids"]) == clean[3][1]
