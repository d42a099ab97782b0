"""Jaccard join, substring dedup and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SCHEMA, clashing, sentence

from pyspark.sql import functions as F

from claimloom.llm import decontam, jaccard, substrings


def brute_components(rows, shingle=3, percent=90):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        n = min(shingle, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def components(df, shingle=3, percent=90, **how):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, shingle, percent, **how).collect())


def test_jaccard(docs, docs_rows):
    assert components(clashing(docs)) == brute_components(docs_rows)


@pytest.mark.parametrize("percent", [50, 80])
def test_jaccard_other_thresholds(docs, docs_rows, percent):
    assert components(docs, percent=percent) == brute_components(docs_rows, percent=percent)


def test_jaccard_chains(spark):
    """A chain links only neighbours, and leaders seldom see all of them."""
    rng = random.Random(3)
    words, rows = sentence(rng, 100).split(), []
    for i in range(40):
        rows.append((i * 7 % 40, " ".join(words), "en", "s", 0))
        words = words[:]
        words[(i * 9) % 100] = f"new{i}"
    df = spark.createDataFrame(rows, SCHEMA)
    for rounds in (0, 1, 4):
        assert components(df, rounds=rounds) == brute_components(rows)


def test_jaccard_ids(spark):
    text = sentence(random.Random(4), 50)
    rows = [(None, text, "en", "s", 0), (5, text + " more", "en", "s", 0), (5, "other text of its own here", "en", "s", 0), (None, None, "en", "s", 0), (7, "Other TEXT of its own here", "en", "s", 0)]
    assert components(spark.createDataFrame(rows, SCHEMA)) == brute_components(rows)


def test_jaccard_empty(empty):
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_stage_links_five_word_shingles_from_80_percent(spark, docs, docs_rows):
    out = jaccard.stage(spark, docs, "")
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(kept) == sorted({c for (_, _, c) in brute_components(docs_rows, shingle=5, percent=80)})
    words = sentence(random.Random(6), 300).split()
    near = words[:]
    for i in range(20, 300, 50):
        near[i] = f"new{i}"
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(near), "en", "s", 0)]
    assert len(brute_components(rows, 5, 80)) == 2 and {c for (_, _, c) in brute_components(rows, 5, 80)} == {1} and {c for (_, _, c) in brute_components(rows)} == {1, 2}
    assert [r["doc_id"] for r in jaccard.stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [1]


def test_jaccard_stage_keeps_unlinked_texts_of_one_id_or_none(spark):
    rng = random.Random(10)
    a, b, c, d, e = (sentence(rng, 120) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (3, c), (3, d), (3, e), (1, c + " more"), (9, a + " more"), (4, ""), (4, None), (4, " ")]
    kept = jaccard.stage(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA), "")
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(None, b), (3, d), (3, e), (1, c + " more"), (9, a + " more"), (4, ""), (4, None), (4, " ")])


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_needed_is_a_lower_bound(percent):
    """Whatever two sets link, their differences from a leader overlap by at least what is needed."""
    rng = random.Random(percent)
    checked = 0
    while checked < 300:
        lead = set(range(rng.randint(3, 40)))
        a, b = set(lead), set(lead)
        for x in (a, b):
            for _ in range(rng.randint(0, 12)):
                x.symmetric_difference_update({rng.randint(0, 60)})
        if not a or not b or 100 * len(a & b) < percent * len(a | b):
            continue
        own, other = a ^ lead, b ^ lead
        linked = 100 * len(b & lead) >= percent * len(b | lead)
        least = jaccard.needed(len(a), len(lead), len(own), percent, linked)
        if not linked or 100 * len(a & lead) < percent * len(a | lead):  # two that are linked with the leader need no comparison
            assert least is not None and len(own & other) >= least
            checked += 1


def near_copies(rng, n, edits, size=120):
    base = sentence(rng, size).split()
    rows = [(0, " ".join(base), "en", "s", 0)]
    for i in range(1, n):
        words = base[:]
        for at in rng.sample(range(size), rng.randint(*edits)):
            words[at] = "".join(rng.choice("abcdefghij") for _ in range(8))
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows


def test_jaccard_many_near_copies_are_not_compared_with_each_other(spark, monkeypatch):
    """Half of the copies are too far from the text they stem from and from all others; pairs stay few."""
    rows = near_copies(random.Random(8), 1200, (1, 8))
    pairs = []
    compared = jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda p, *a: pairs.append(p.count()) or compared(p, *a))
    out = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    sets = [jaccard.shingle_set(r[1]) for r in rows]
    share = {i: 100 * len(set(s) & set(sets[0])) / len(set(s) | set(sets[0])) for i, s in enumerate(sets)}
    far = [i for i, x in share.items() if x < 80]
    assert 300 < len(far) < 900
    found = {r["doc_id"]: r["component_id"] for r in out}
    assert all(found[i] == 0 for i in share if i not in far) and sum(found[i] == i for i in far) > 0.9 * len(far)
    assert sum(pairs) < 10 * len(rows)


def test_jaccard_near_copies_of_near_copies(spark):
    """Few words to choose from, so that many differences are shared and several rounds are needed."""
    rng = random.Random(12)
    base = sentence(rng, 60).split()
    rows = []
    for i in range(150):
        words = base[:]
        for at in rng.sample(range(60), rng.randint(0, 6)):
            words[at] = rng.choice(["red", "blue"])
        rows.append((i, " ".join(words), "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    for rounds in (1, 4):
        assert components(df, 5, 80, rounds=rounds) == brute_components(rows, 5, 80)


def brute_removed(rows, window):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in texts:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        left = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((doc_id, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window,m,bucket", [(35, 8, 400), (35, 8, 2), (10, 4, 5), (5, 5, 1)])
def test_substrings(docs, docs_rows, window, m, bucket):
    out = substrings.remove_repeats(clashing(docs), window=window, m=m, bucket=bucket).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_removed(docs_rows, window)


def test_substrings_text(docs):
    for r in substrings.remove_repeats(docs, keep_text=True).collect():
        if r["n_removed"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_substrings_empty(empty):
    assert substrings.remove_repeats(empty).count() == 0


def items_and_leaks(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randint(15, 60))) for i in range(12)]
    rows, leaked = [], set()
    for i in range(60):
        text = sentence(rng, 120)
        if i % 5 == 0:
            item, words = items[i % 12], items[i % 12][1].split()
            if i % 2:
                words[len(words) // 2] = "changed"
            text = f"{text}. {' '.join(words).upper() if i % 3 == 0 else ' '.join(words)}, {sentence(rng, 40)}"
            leaked.add((i, item[0]))
        rows.append((i, text, "en", "s", 0))
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "word " * 4000, "en", "s", 0), rows[0], (None, items[3][1], "en", "s", 0)]
    items += [(50, None), (51, ""), (52, "too short"), items[0]]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), leaked | {(None, 3)}


def test_decontamination(spark):
    df, items, leaked = items_and_leaks(spark)
    out = decontam.contaminated(clashing(df).drop("item_id"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == leaked and len(out) == len(leaked)
    assert all(r["overlap"] >= 0.9 and r["last_word"] - r["first_word"] + 1 == r["n_item"] for r in out)


def test_decontamination_part_of_a_long_item(spark):
    rng = random.Random(5)
    item = sentence(rng, 400)
    rows = [(1, sentence(rng, 50) + " " + " ".join(item.split()[100:130]) + " " + sentence(rng, 50), "en", "s", 0), (2, sentence(rng, 200), "en", "s", 0)]
    out = decontam.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert [r["doc_id"] for r in out.collect()] == [1]


def brute_contaminated(rows, items):
    split = lambda t: [w for w in re.split(decontam.SEPARATORS, (t or "").lower()) if w]
    found = {}
    for doc_id, text, *_ in rows:
        w = split(text)
        for item_id, t in set(items):
            x = split(t)
            if len(x) < 9:
                continue
            hits = set()
            for mask in decontam.MASKS:
                at = {}
                for i in range(len(x) - mask[-1]):
                    at.setdefault(tuple(x[i + o] for o in mask), []).append(i)
                for j in range(len(w) - mask[-1]):
                    hits |= {j - i for i in at.get(tuple(w[j + o] for o in mask), ())}
            for d in hits:
                near = [e for e in hits if d - decontam.GAP <= e <= d]
                same = [any(0 <= i + e < len(w) and w[i + e] == x[i] for e in near) for i in range(len(x))]
                run = max(sum(same[i : i + 20]) for i in range(max(1, len(same) - 19)))
                if sum(same) >= 0.6 * len(x) or len(x) >= 20 and run >= 16:
                    found[doc_id, text, item_id] = max(found.get((doc_id, text, item_id), 0), sum(same) / len(x))
    return Counter((d, i, round(o, 9)) for (d, _, i), o in found.items())


def test_decontamination_against_brute_force(spark):
    """Words changed, left out and put in at all rates; items without an id, and two texts with one."""
    rng = random.Random(21)
    items = [(i if i % 7 else None, sentence(rng, rng.randint(9, 60))) for i in range(40)] + [(1, sentence(rng, 30))]
    rows = []
    for i in range(120):
        words = items[i % 41][1].split()
        for _ in range(rng.randint(0, len(words) // 2)):
            at, way = rng.randrange(len(words)), rng.random()
            words[at : at + 1] = [] if way < 0.2 else ["new", words[at]] if way < 0.4 else ["changed"]
            words = words or ["x"]
        rows.append((i, f"{sentence(rng, rng.randint(0, 40))} {' '.join(words)} {sentence(rng, rng.randint(0, 40))}", "en", "s", 0))
    rows.append((200, "to be or not to be " * 300, "en", "s", 0))
    items.append((90, "to be or not to be " * 6))
    out = decontam.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["overlap"], 9)) for r in out) == brute_contaminated(rows, items)
    assert len(out) > 60


def test_decontamination_over_a_word_put_in(spark):
    item = sentence(random.Random(22), 24).split()
    text = " ".join([*item[:12], "moreover", *item[12:]])
    out = decontam.contaminated(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(None, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r["item_id"], r["n_matched"]) for r in out] == [(None, 24)]


@pytest.mark.parametrize("of", [jaccard, decontam])
def test_stages_keep_columns_of_any_name(spark, docs, tmp_path, of):
    odd = ["_keep", "_h", "_hash", "_id", "_row", "a.b", "h", "k", "component", "sig"]
    spark.createDataFrame([(1, sentence(random.Random(1), 30))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(odd)])
    out = of.stage(spark, wide, str(tmp_path))
    assert out.columns == wide.columns
    plain = of.stage(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r["doc_id"], r["text"]) for r in plain.collect())


def test_decontamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contaminated(docs, none).count() == 0
    assert decontam.contaminated(empty, spark.createDataFrame([(1, "a " * 20)], "item_id bigint, text string")).count() == 0
