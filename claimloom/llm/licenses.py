"""License scans.

Base: places of fixed phrases. Method: an exact containment join of text blocks
with a table of license templates. A template's block is a line that holds it to
the threshold or, where no line does, a run of words of a paragraph, longer than
the template by ``1 / t`` at most, so that templates wrapped over lines are
found. The words of all templates are ordered by how many documents hold them,
rarest first. A block that holds a share ``t`` of a template's words must hold
one of its first ``n - ceil(t n) + 1`` words in that order: these make an index,
which blocks meet in an equi-join on words (prefix filter). Pairs need enough
words (length filter) and room after the first common word (positional filter);
what is left is counted exactly.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

#: Phrase, label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Template text, label.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
]
THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Blank lines, which part paragraphs.
BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An index of templates up to so many bytes is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 1 << 25


def license_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _literal(words: list[str]) -> Column:
    """Words without blanks as one literal, however many."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.expr("cast(array() as array<string>)")


def template_order(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> list[str]:
    """All template words, by the number of documents that hold them, then by word."""
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.explode_outer(F.array_intersect(_literal(vocabulary), license_words(text))).alias("w"))
    counts = dict(held.filter(F.col("w").isNotNull()).groupBy("w").count().collect())  # a row per template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def plan(order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Rows of the table of templates: words in global order, least overlap, words of the prefix and of a run."""
    rank, out = {w: i for i, w in enumerate(order)}, []
    for k, (text, label) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.__getitem__)
        least = max(1, math.ceil(threshold * len(words) - 1e-9))
        out.append({"template": k, "label": label, "words": words, "least": least, "prefix": len(words) - least + 1, "run": math.ceil(len(text.split()) / threshold - 1e-9)})
    return out


def _blocks(t: Column, prefixes: Column, step: int) -> Column:
    """Lines, and overlapping windows of paragraphs, that hold a word of some prefix."""

    def windows(p):  # of 2 * step words, step apart: they hold any run of step words
        starts = F.sequence(F.lit(1), F.greatest(F.size(p) - step, F.lit(1)), F.lit(step))
        return F.transform(starts, lambda i: F.struct(F.lit(True).alias("wrapped"), F.slice(p, i, 2 * step).alias("block")))

    lines = F.transform(F.split(t, "\n"), lambda x: F.struct(F.lit(False).alias("wrapped"), license_words(x).alias("block")))
    parts = F.flatten(F.transform(F.split(t, BLANK), lambda p: util.let(license_words(p), windows)))
    return F.filter(F.concat(lines, parts), lambda b: F.arrays_overlap(b["block"], prefixes))


def template_matches(texts: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(h, more, best): labels of the templates that a text holds, and their largest containment, over rows (h, text) of texts without nulls."""
    planned = plan(order, templates, threshold)
    table = util.literal_rows(texts.sparkSession, planned, "template int, label string, words array<string>, least int, prefix int, run int")
    index = table.select("*", F.posexplode(F.slice("words", 1, F.col("prefix"))).alias("place", "word"))
    small = sum(len(w) + 24 for t in planned for _ in range(t["prefix"]) for w in t["words"]) <= BROADCAST_BYTES
    index = F.broadcast(index) if small else index
    prefixes = _literal(sorted({w for t in planned for w in t["words"][: t["prefix"]]}))
    blocks = util.computed(texts, F.struct(_blocks(F.col("text"), prefixes, max((t["run"] for t in planned), default=1)).alias("blocks")))
    blocks = blocks.select("h", F.inline("blocks"))
    known = util.computed(blocks, F.struct(F.array_intersect(_literal(order), F.col("block")).alias("known")))  # in the global order, without repeats
    met = known.select("*", F.posexplode("known").alias("at", "word")).join(index, "word")
    room = 1 + F.least(F.size("words") - 1 - F.col("place"), F.size("known") - 1 - F.col("at"))
    first = F.get(F.array_intersect(F.slice("words", 1, F.col("prefix")), "known"), F.lit(0)) == F.col("word")
    met = met.filter((F.size("known") >= F.col("least")) & (room >= F.col("least")) & first)
    whole = F.size(F.array_intersect("words", "known"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("block") - F.col("run") + 1, F.lit(1)))
    in_a_run = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.col("words"), F.slice(F.col("block"), i, F.col("run"))))))
    counted = met.withColumn("overlap", F.when(whole >= F.col("least"), F.when(F.col("wrapped"), in_a_run).otherwise(whole)))
    counted = counted.filter(F.col("overlap") >= F.col("least")).withColumn("score", F.col("overlap") / F.size("words"))
    best = lambda wrapped: F.max(F.when(F.col("wrapped") == wrapped, F.col("score")))
    each = counted.groupBy("h", "template", "label").agg(F.coalesce(best(False), best(True)).alias("score"))
    return each.groupBy("h").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))


def scan_licenses(docs: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a phrase stands, else the largest containment of a
    matching block, else 0. Null texts count as empty: no words, no places,
    empty labels. Repeated rows stay; very long texts are taken whole; an empty
    table stays empty. Columns of ``docs`` with these names are replaced.

    A paragraph is a run of lines that are not blank. Overlapping windows hold any
    run as long as the longest template allows; what matches a window counts by
    the best run of the template's own length over the threshold, as words strewn
    over a paragraph are no notice.
    """
    prefixes = _literal(sorted({w for t in plan(order, templates, threshold) for w in t["words"][: t["prefix"]]}))
    no_places = F.expr("cast(array() as array<struct<at:bigint,label:string>>)")

    def places(w):
        def of(phrase, label):
            parts = phrase.split()
            here = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: reduce(lambda x, y: x & y, [F.coalesce(F.get(w, i + k) == parts[k], F.lit(False)) for k in reversed(range(len(parts)))]))
            return F.transform(here, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))

        return F.concat(*[of(p, label) for p, label in PHRASES])

    def base(w):
        def joined(b):
            at, labels = F.transform(b, lambda x: x["at"]), F.transform(b, lambda x: x["label"])
            return F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.size(b).cast("bigint").alias("n_base"),
                F.array_min(at).alias("first_word"),
                F.array_max(at).alias("last_word"),
                F.array_distinct(labels).alias("base_labels"),
                F.arrays_overlap(w, prefixes).alias("_hint"),
            )

        return util.let(F.when(F.array_contains(w, "license"), places(w)).otherwise(no_places), joined)

    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.columns if keep is None else keep
    taken = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c.lower() not in taken]).alias("_row"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = util.computed(rows, util.let(license_words(F.col("text")), base))
    texts = util.stored(rows.filter("_hint").select("h", "text").dropDuplicates(["h"]), "hinted")
    found = util.stored(template_matches(texts, order, templates, threshold), "licenses").withColumnRenamed("h", "_h")
    util.discard(texts)
    out = rows.drop("text").join(found, F.col("h") == F.col("_h"), "left")
    named = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(
        "_row.*",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        named(F.col("base_labels")).alias("base_labels"),
        named(F.array_union("base_labels", F.coalesce("more", F.expr("cast(array() as array<string>)")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, template_order(docs), keep=["doc_id"])


def sql() -> str:
    """DuckDB twin of :func:`query`, from the same phrases and templates."""
    phrases = ", ".join(f"('{p}', '{x}')" for p, x in PHRASES)
    templates = ", ".join(f"({k}, '{t}', '{x}')" for k, (t, x) in enumerate(TEMPLATES))
    step = max(math.ceil(len(t.split()) / THRESHOLD - 1e-9) for t, _ in TEMPLATES)
    words = r"[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{words}') AS w FROM d),
ph(phrase, label) AS (VALUES {phrases}), tm(k2, template, label) AS (VALUES {templates}),
tw AS (SELECT k2, label, list_distinct(string_split(template, ' ')) AS tw, CAST(ceil(len(string_split(template, ' ')) / {THRESHOLD} - 1e-9) AS BIGINT) AS run FROM tm),
tn AS (SELECT *, ceil({THRESHOLD} * len(tw) - 1e-9) AS least FROM tw),
i AS (SELECT k, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
h AS (SELECT k, i - 1 AS pos, label FROM i JOIN ph ON array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
b AS (SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM h GROUP BY k),
l AS (SELECT k, list_distinct(regexp_extract_all(line, '{words}')) AS lw FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)),
ml AS (SELECT k, k2, label, max(len(list_intersect(tw, lw)) / len(tw)) AS share FROM l, tn WHERE len(lw) > 0 AND len(list_intersect(tw, lw)) >= least GROUP BY ALL),
pa AS (SELECT k, regexp_extract_all(part, '{words}') AS p FROM (SELECT k, unnest(regexp_split_to_array(t, '\n(?:[\x20\x09\x0B-\x0D]*\n)+')) AS part FROM d)),
wi AS (SELECT k, p[i:i + {2 * step - 1}] AS b FROM (SELECT k, p, unnest(generate_series(1, greatest(len(p) - {step}, 1), {step})) AS i FROM pa WHERE len(p) > 0)),
ru AS (SELECT k, k2, label, least, len(tw) AS n, list_max(list_transform(generate_series(1, greatest(len(b) - run + 1, 1)), lambda j: len(list_intersect(tw, b[j:j + run - 1])))) AS o FROM wi, tn WHERE len(list_intersect(tw, b)) >= least),
mw AS (SELECT k, k2, label, max(o / n) AS share FROM ru WHERE o >= least GROUP BY ALL),
m AS (SELECT * FROM ml UNION ALL SELECT mw.* FROM mw ANTI JOIN ml USING (k, k2)),
a AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM h UNION ALL SELECT k, label FROM m) GROUP BY k),
bl AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY k),
s AS (SELECT k, max(share) AS share FROM m GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (k) LEFT JOIN a USING (k) LEFT JOIN bl USING (k) LEFT JOIN s USING (k)
"""
