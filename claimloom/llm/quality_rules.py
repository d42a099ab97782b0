"""Quality rules: base counts, then distribution divergence.

A document's histograms of character classes and of common words are compared
to the reference of its language by Jensen-Shannon distance. References are
means over all documents that pass the base rules. Documents below a length are
not judged by distance, since short texts stray from any reference by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

#: Frequent words of each language, most frequent first.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on are at this or".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec ne".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein als auch".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Not ASCII punctuation; single characters match faster than ranges.
MARKS = r"""[^!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""
CLASSES = ["lower", "upper", "digit", "space", "mark", "symbol", "wide"]

#: Base rules.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Distances (base 2, 0 to 1) above which a document is rejected, and words below which it is not judged.
CHAR_LIMIT, WORD_LIMIT, GUARD_WORDS = 0.27, 0.31, 100


def _count(text: Column, other: str) -> Column:
    """Code points of ``text`` outside the class ``other``, a negated class of Java's."""
    return F.length(F.regexp_replace(text, other, "")).cast("bigint")


def class_counts(text: Column, n_space: Column, n_symbols: Column) -> Column:
    """Counts of ``CLASSES`` in a text: lower case is what the other classes leave."""
    upper, digit = _count(text, "[^A-Z]+"), _count(text, "[^0-9]+")
    marks, wide = _count(text, MARKS), _count(text, r"[\x00-\x7F]+")

    def all_of(a):
        rest = F.length(text).cast("bigint") - n_space - F.aggregate(F.slice(a, 1, 4), F.lit(0).cast("bigint"), lambda x, y: x + y)
        return F.array(rest, a[0], a[1], n_space, a[2] - a[4], a[4], a[3])

    return util.let(F.array(upper, digit, marks, wide, n_symbols), all_of)


def word_counts(words: Column, lang: str) -> Column:
    """Counts of the common words of ``lang``, lower-cased, then of all other words."""
    common = COMMON[lang]
    marks = [chr(97 + i) for i in range(len(common))]
    mark_of = F.map_from_arrays(F.array(*map(F.lit, common)), F.array(*map(F.lit, marks)))
    joined = F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 6, F.try_element_at(mark_of, F.lower(w)))), "")

    def counts(s):
        each = [(F.length(s) - F.length(F.replace(s, F.lit(m), F.lit("")))).cast("bigint") for m in marks]
        return F.array(*each, F.size(words).cast("bigint") - F.length(s))

    return util.let(joined, counts)


def shares(counts: Column) -> Column:
    """Counts to shares of their sum; all zero if the sum is."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return util.let(counts, lambda a: util.let(total(a), lambda n: F.transform(a, lambda x: x / F.greatest(n, F.lit(1)))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2: the root of the divergence."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.when(p.isNotNull(), F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda x, y: x + y), F.lit(0.0))))


def add_repeat_words(df: DataFrame, words: str) -> DataFrame:
    """Adds n_repeat_words: words of the array ``words`` that 3-word windows found twice or more cover.

    Each window is a long: a hash in the high bits, its place in the low ones.
    Sorting brings equal windows together; the words themselves confirm. Where
    they do not, different windows share a hash, and the document's windows are
    sorted by their words instead. The steps are operators of their own so that
    the sort runs in generated code on primitive longs.
    """
    w, mask = F.col(words), F.col("_mask")
    bits = F.length(F.bin(F.size(words)))
    df = util.computed(df, F.struct((F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).alias("_mask")))
    last = F.greatest(F.size(words) - 3, F.lit(0))
    packed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint")))
    df = util.computed(df, F.struct(F.sort_array(packed).alias("_packed")))
    s = F.col("_packed")

    def alike(i):
        return F.get(s, i).bitwiseAND(F.bitwise_not(mask)) == F.get(s, i - 1).bitwiseAND(F.bitwise_not(mask))

    def confirmed(i):
        place = lambda k: F.get(s, k).bitwiseAND(mask).cast("int")
        same = [F.get(w, place(i) + k) == F.get(w, place(i - 1) + k) for k in range(3)]
        return same[0] & same[1] & same[2]

    near = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), alike)
    df = util.computed(df, F.struct(near.alias("_near")))
    pairs = F.transform("_near", lambda i: F.when(confirmed(i), F.array(F.get(s, i).bitwiseAND(mask), F.get(s, i - 1).bitwiseAND(mask))))
    df = util.computed(df, F.struct(pairs.alias("_pairs")))

    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 3)).alias("x"), i.cast("bigint").alias("i")))

    def of_sorted(a):
        same = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.get(a, i)["x"] == F.get(a, i - 1)["x"])
        return F.flatten(F.transform(same, lambda i: F.array(F.get(a, i)["i"], F.get(a, i - 1)["i"])))

    shared = F.exists("_pairs", lambda x: x.isNull())
    places = F.when(shared, util.let(F.array_sort(each), of_sorted)).otherwise(F.flatten("_pairs"))

    def length(p):
        steps = F.transform(p, lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("bigint"))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda x, y: x + y)

    n = F.when(F.size(words) >= 3, util.let(F.array_sort(F.array_distinct(places)), length)).otherwise(F.lit(0).cast("bigint"))
    return util.computed(df, F.struct(n.alias("n_repeat_words"))).drop("_mask", "_packed", "_near", "_pairs")


def base_counts(text: Column, w: Column) -> dict[str, Column]:
    has_word = r"[^\x20\x09-\x0D]"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))
    return {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": _count(text, r"[^#*$%&|<>]+"),
        "n_dup_lines": util.let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
    }


def measured(docs: DataFrame, langs: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds the base counts, and shares of character classes and of words by language as ``_chars`` and ``_words``."""
    out = util.computed(docs, F.struct(util.words(F.col(text_col)).alias("_w")))

    def measure(t):
        def with_base(b):
            by_lang = F.array(*[F.when(_own(lang_col, lang, langs), shares(word_counts(w, lang))) for lang in langs])
            n_space = F.length(t) - b["word_chars"]
            return F.struct(*[b[k].alias(k) for k in base], shares(class_counts(t, n_space, b["n_symbols"])).alias("_chars"), by_lang.alias("_words"))

        w = F.col("_w")
        base = base_counts(t, w)
        return util.let(F.struct(*[v.alias(k) for k, v in base.items()]), with_base)

    out = util.computed(out, util.let(F.coalesce(F.col(text_col), F.lit("")), measure))
    return add_repeat_words(out, "_w").drop("_w")


def _own(lang_col: str, lang: str, langs: list[str]) -> Column:
    """Whether a document is held against the reference of ``lang``: its own, or any if its own has none."""
    known = F.col(lang_col).isin(langs)
    return (F.col(lang_col) == lang) | ~F.coalesce(known, F.lit(False))


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fit_references(measures: DataFrame, langs: list[str], lang_col: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Mean histograms of each language over all its documents that pass the base rules.

    Takes what :func:`measured` gives. The result has one row per language of
    ``langs``, of fixed length; languages without such documents are left out.
    """
    m = measures.filter(F.col(lang_col).isin(langs) & ~_base_failed())
    m = m.select(F.col(lang_col).alias("lang"), F.col("_chars").alias("c"), F.coalesce(*[F.col("_words")[i] for i in range(len(langs))]).alias("w"))
    n_words = len(next(iter(COMMON.values()))) + 1
    means = [F.avg(F.col("c")[i]) for i in range(len(CLASSES))], [F.avg(F.col("w")[i]) for i in range(n_words)]
    found = m.groupBy("lang").agg(F.array(*means[0]).alias("chars"), F.array(*means[1]).alias("words")).collect()  # a row per language
    return {r["lang"]: {"chars": r["chars"], "words": r["words"]} for r in found}


def judge(docs: DataFrame, references: dict | None = None, text_col: str = "text", lang_col: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, guard_words: int = GUARD_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``, the language among them) with columns of the base counts, base_failed, char_distance, word_distance and kept.

    Without ``references`` they are fitted to all of ``docs``. The measures are
    written to the shared folder once and serve both the fit and the verdicts.
    A document whose language has no reference, or is null, is held against the
    nearest one. Null and empty texts have no words and fail the base rules.
    Columns of ``docs`` with the same names are replaced; repeated rows stay;
    very long texts are taken whole; an empty table stays empty.
    """
    langs = list(COMMON)
    out = measured(docs, langs, text_col, lang_col)
    if keep is not None:
        out = out.drop(*[c for c in docs.columns if c not in keep])
    if references is None:
        out = util.stored(out, "measures")
        references = fit_references(out, langs, lang_col)
    refs = lambda kind: [(i, x, F.array(*map(F.lit, references[x][kind]))) for i, x in enumerate(langs) if x in references]
    nearest = lambda d: F.coalesce(F.array_min(F.array(*d)) if d else F.lit(0.0), F.lit(0.0))
    own = lambda x: _own(lang_col, x, list(references))
    chars = nearest([F.when(own(x), js_distance(F.col("_chars"), r)) for i, x, r in refs("chars")])
    words = nearest([F.when(own(x), js_distance(F.col("_words")[i], r)) for i, x, r in refs("words")])
    out = util.computed(out, F.struct(_base_failed().alias("base_failed"), F.round(chars, 6).alias("char_distance"), F.round(words, 6).alias("word_distance"))).drop("_chars", "_words")
    far = (F.col("char_distance") > char_limit) | (F.col("word_distance") > word_limit)
    return out.withColumn("kept", ~F.col("base_failed") & ~((F.col("n_words") >= guard_words) & far))


def query(spark, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, keep=["doc_id", "lang"]).drop("lang")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; all columns as they came, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang")
    return judge(rows, keep=["_row", "lang"]).filter("kept").select("_row.*")
