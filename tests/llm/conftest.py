import random

import pytest

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
COMMON = "the of and to in a is that for it".split()


def sentence(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.3 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, odd and missing texts."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.choice([5, 40, 120, 300])) for _ in range(n)]
    passage = sentence(rng, 60)
    for i in range(0, n, 6):
        texts[i] += "\n" + passage + " " + sentence(rng, 30)
    base = sentence(rng, 200)
    texts += [base] * 4
    for _ in range(12):
        words = base.split()
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(99))
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t", "one", "two words", "three short words", "\u00a0é\u2003x y\x1fz", "word " * 3000, "x" * 20000, "a b c " * 50]
    rows = [(i, t, rng.choice(["en", "fr", None, "xx"]), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2]]  # repeated rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["h", "n", "sig", "keys", "v", "words", "n_words", "kept", "score", "labels", "found", "_made_", "seed", "place", "size", "shard", "key", "base_spans", "item_id"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
