"""Secret scans.

Base: three fixed patterns. Method: two character Markov models, one of random
strings and one of ordinary identifiers, trained from labelled samples. A long
token whose log-likelihood ratio per character pair exceeds a limit is a span of
kind ``markov``; where a token as a whole does not, segments of it are judged,
so that a random string joined to ordinary words is found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
#: Runs of a class are matched whole, so the least length can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]

#: Tokens that the models judge: this pattern, a limit in nats for each pair.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LIMIT = 1.0
#: Least characters of a segment; a segment ends where its sum over the limit fell by so many nats; characters that part words.
LEAST, DROP, PARTERS = 20, 8.0, "/_=+-"
#: Pairs of a token whose segments are gathered together.
SEGMENT_BLOCK = 1024
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Samples of ordinary identifiers, paths and numbers (label 0).
ORDINARY = """
get_user_name set_user_name max_retries connection_timeout response_status_code request_headers content-type
application/json user_id order_number customer_address shipping_method invoice_total payment_reference last_modified
created_at updated_at is_active has_children parent_node child_index row_count column_names table_schema primary_key
foreign_key index_name query_string search_results page_number items_per_page total_count next_page previous_page
fileName filePath directoryName absolutePath relativePath parseInteger formatDate toLowerCase toUpperCase isEmpty
hasNext getInstance createConnection openStream closeStream readLine writeBytes flushBuffer threadPool taskQueue
eventListener messageHandler errorMessage warningCount logLevel debugMode configurationManager serviceProvider
internationalization responsibilities characteristic representation communication administration transportation
government development information organization environment understanding performance international relationship
http/www/example/index/page/article/section/chapter/appendix usr/local/share/documentation home/projects/source/main
version_1 version_2 release_2020 build_1234 chapter_10 figure_3 table_12 2019-01-31 2021-12-05 10000 1234567890 000000
north_america south_europe east_asia west_africa monday tuesday wednesday thursday friday saturday sunday january
february march april may june july august september october november december
""".split()
RANDOM_SAMPLES = 4096


def labelled_samples(spark) -> DataFrame:
    """Rows (text, label): random strings over base64, hex and capitals (1), ordinary identifiers, also in capitals (0)."""
    ids = spark.range(RANDOM_SAMPLES)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    text = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.upper(F.substring(raw, 1, 20))).otherwise(F.regexp_replace(raw, "=+$", ""))
    plain = util.literal_rows(spark, [{"text": y} for x in ORDINARY for y in (x, x.upper())], "text string")
    return ids.select(text.alias("text"), F.lit(1).alias("label")).unionByName(plain.select("text", F.lit(0).alias("label")))


def train(samples: DataFrame, weight: float = 2.0) -> dict:
    """Log-likelihood ratio of each pair of characters, random over ordinary.

    Counts pairs natively; the result is as long as the alphabet squared. Each
    model falls back to how frequent the second character is in its class, with
    ``weight`` pairs' worth. Null texts and characters outside the alphabet are
    ignored.
    """
    pairs = samples.filter(F.col("text").isNotNull() & F.col("label").isNotNull()).select("label", F.explode(F.when(F.length("text") > 1, F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2))))).alias("pair"))
    n, of_pair = len(ALPHABET), [{}, {}]
    for label, pair, k in pairs.groupBy("label", "pair").count().collect():  # at most 2 x alphabet squared
        if len(pair) == 2 and pair[0] in ALPHABET and pair[1] in ALPHABET and int(label) in (0, 1):
            of_pair[int(label)][pair] = k
    logs = []
    for counts in of_pair:
        total = sum(counts.values())
        first = {a: sum(counts.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        second = {b: (sum(counts.get(a + b, 0) for a in ALPHABET) + 0.5) / (total + 0.5 * n) for b in ALPHABET}
        logs.append([math.log((counts.get(a + b, 0) + weight * second[b]) / (first[a] + weight)) for a in ALPHABET for b in ALPHABET])
    return {"alphabet": ALPHABET, "ratio": [round(x - y, 6) for x, y in zip(logs[1], logs[0], strict=True)]}


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (start, kind, end) of all matches; places follow from the lengths of matches and of what stands between."""
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wanted = keep(text) if keep else None

    def spans(b):
        def with_found(m):
            own = F.transform(m, F.length)  # one fewer than the pieces between
            ends = util.prefix_sums(F.zip_with(F.slice(b, 1, F.size(m)), own, lambda x, y: F.length(x) + y))
            all_spans = F.zip_with(ends, own, lambda e, n: F.struct((e - n).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
            if wanted is None:
                return all_spans
            return util.let(wanted, lambda k: F.filter(all_spans, lambda s, i: F.get(k, i)))

        return util.let(found, with_found)

    return util.let(between, spans)


def _random(model: dict, token: Column, limit: float) -> Column:
    """Parts (a, b) of a token that are random: all of it where its mean log-likelihood ratio for each pair exceeds ``limit``, else segments.

    A segment is a run of pairs whose running sum of ratio less ``limit`` stays
    over zero, up to where it is largest. Both ends or one move out to the next
    character that parts words if the mean still exceeds the limit. Segments are
    gathered block by block, means come from prefix sums and the characters that part
    words from running places, so that a token of any length costs about its length.
    """
    ratio = F.split(F.lit(",".join(map(repr, model["ratio"]))), ",").cast("array<double>")
    alphabet, n = F.lit(model["alphabet"]), len(model["alphabet"])
    codes = F.transform(F.split(token, ""), lambda c: F.call_function("instr", alphabet, c) - 1)
    part = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    mean = lambda r: F.aggregate(r, F.lit(0.0), lambda x, y: x + y) / F.size(r)
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def raw_segments(r):
        def state(i, a, total, top, b, out):
            return F.struct(i.alias("i"), a.alias("a"), total.alias("sum"), top.alias("top"), b.alias("b"), out.alias("out"))

        def closed(acc):  # short ones too: the ends may still move out
            return F.when(acc["top"] > 0, F.concat(acc["out"], F.array(part(acc["a"], acc["b"])))).otherwise(acc["out"])

        def step(acc, x):
            total = acc["sum"] + x - limit
            ends = (total <= 0) | (total < acc["top"] - DROP)
            more = total > acc["top"]
            i = acc["i"] + 1
            return state(
                i,
                F.when(ends, i).otherwise(acc["a"]),
                F.when(ends, F.lit(0.0)).otherwise(total),
                F.when(ends, F.lit(0.0)).when(more, total).otherwise(acc["top"]),
                F.when(ends, i).when(more, i + 1).otherwise(acc["b"]),
                F.when(ends, closed(acc)).otherwise(acc["out"]),
            )

        def block(acc, k):  # a block gathers its own segments, so that a step does not carry all those before
            own = state(acc["i"], acc["a"], acc["sum"], acc["top"], acc["b"], none)
            return F.aggregate(F.slice(r, k * SEGMENT_BLOCK + 1, F.lit(SEGMENT_BLOCK)), own, step, lambda x: state(x["i"], x["a"], x["sum"], x["top"], x["b"], F.concat(acc["out"], x["out"])))

        zero = state(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), none)
        blocks = F.sequence(F.lit(0), ((F.size(r) - 1) / SEGMENT_BLOCK).cast("int"))
        return F.aggregate(blocks, zero, block, closed)

    def segments(r):
        chars = F.split(F.translate(token, PARTERS, PARTERS[-1] * len(PARTERS)), "")
        parter = lambda c: c == PARTERS[-1]
        after = util.running(F.transform(chars, lambda c, i: F.when(parter(c), i + 1).otherwise(0)), F.greatest)  # where the word of each place begins
        until = F.reverse(util.running(F.reverse(F.transform(chars, lambda c, i: F.when(parter(c), i).otherwise(F.length(token)))), F.least))  # and where it ends

        def of_sums(sums, after, until, found):
            total = lambda a, b: F.coalesce(F.get(sums, b - 1), F.lit(0.0)) - F.coalesce(F.get(sums, a - 1), F.lit(0.0))

            def widened(s):
                a = F.coalesce(F.get(after, s["a"] - 1), F.lit(0))
                b = F.coalesce(F.get(until, s["b"]), F.length(token))

                def long(x):
                    pairs = x["b"] - x["a"] - 1
                    return (x["b"] - x["a"] >= LEAST) & (total(x["a"], x["b"] - 1) / pairs > limit)

                ways = F.array(part(a, b), part(s["a"], b), part(a, s["b"]), part(s["a"], s["b"]))
                return F.get(F.filter(ways, long), F.lit(0))

            return util.let(F.array_compact(F.transform(found, widened)), lambda w: F.filter(w, lambda x, i: (i == 0) | (F.get(w, i - 1) != x)))

        def with_found(found):
            return util.let(util.prefix_sums(r), lambda sums: util.let(after, lambda x: util.let(until, lambda y: of_sums(sums, x, y, found))))

        return util.let(raw_segments(r), lambda found: F.when(F.size(found) > 0, with_found(found)).otherwise(none))

    def of_ratios(r):
        return F.when(mean(r) > limit, F.array(part(F.lit(0), F.length(token)))).otherwise(segments(r))

    def of_table(table):
        return util.let(codes, lambda c: util.let(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.get(table, F.get(c, i) * n + F.get(c, i + 1))), of_ratios))

    return util.let(ratio, of_table)


def _replaced(text: Column, found: Column, by) -> Column:
    """``text`` with each run of overlapping spans replaced by what ``by`` makes of its length.

    Linear in the text: characters are an array, and what a run reaches is a running maximum.
    """

    def of_chars(chars):
        def of_reach(reach):
            before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
            last = F.coalesce(F.get(reach, F.size(reach) - 1), F.lit(0))
            firsts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i)["start"] >= before(i)))

            def of_firsts(f):
                def piece(i, k):
                    start, end = F.get(found, i)["start"], F.when(k + 1 < F.size(f), before(F.get(f, k + 1))).otherwise(last)
                    return F.concat(F.array_join(F.slice(chars, before(i) + 1, start - before(i)), ""), by(end - start))

                tail = F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), "")
                return F.concat(F.array_join(F.transform(f, piece), ""), tail)

            return util.let(firsts, of_firsts)

        return util.let(util.running(F.transform(found, lambda s: s["end"]), F.greatest), of_reach)

    return F.when(F.size(found) > 0, util.let(F.split(text, ""), of_chars)).otherwise(text)


def _long_enough(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns in a text that is not null, as (start, kind, end) in order."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    lower = F.lower(text)
    hint = F.lit(False)
    for word in ASSIGN_WORDS:
        hint = hint | F.contains(lower, F.lit(word))
    return F.array_sort(
        F.concat(
            F.when(hint, _matches(text, ASSIGN, 0, _long_enough)).otherwise(none),
            F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, 1)).otherwise(none),
            F.when(text.rlike(HEX), _matches(text, HEX, 2)).otherwise(none),
        )
    )


def model_spans(text: Column, model: dict | None, limit: float = LIMIT) -> Column:
    """Spans of the models, in order."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    if model is None:
        return none
    parts = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda x: _random(model, x, limit))
    placed = lambda s, ps: F.transform(ps, lambda p: F.struct((s["start"] + p["a"]).alias("start"), s["kind"].alias("kind"), (s["start"] + p["b"]).alias("end")))
    return F.when(text.rlike(CANDIDATE), F.flatten(F.zip_with(_matches(text, CANDIDATE, 3), parts, placed))).otherwise(none)


def _text_of(found: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, model: dict | None, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``, arrays of (start, kind, end).

    Places count code points, ends are exclusive, kinds index ``KINDS``. The
    models judge what stands beside base spans, of ``LEAST`` characters or more.
    Equal or overlapping base spans of different kinds all stay, in the order of
    start, then kind. Null and empty texts have no spans; very long texts are
    taken whole; repeated rows stay; columns of these names are replaced; an
    empty table stays empty.
    """

    def found(t):
        def both(b):
            beside = _replaced(t, b, lambda n: F.repeat(F.lit(" "), n))
            more = util.let(beside, lambda x: model_spans(x, model, limit))
            return F.struct(b.alias("base_spans"), F.array_sort(F.concat(b, more)).alias("all_spans"))

        return util.let(base_spans(t), both)

    return util.computed(docs, util.let(F.coalesce(F.col(text_col), F.lit("")), found))


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    return _replaced(text, found, lambda n: F.lit(mark))


def query(spark, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_secrets(docs, train(labelled_samples(spark)))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text_of(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.col("all_spans")).alias("spans"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blotted out; ``n_chars`` follows the text, other columns stay, whatever their names.

    Null and empty texts, repeated rows and an empty table stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    out = scan_secrets(rows, train(labelled_samples(spark)))
    out = util.computed(out, F.struct(redact(F.col("text"), F.col("all_spans")).alias("_text"), (F.size("all_spans") > 0).alias("_found")))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("_text").alias(c)
        if c == "n_chars":
            return F.when(F.col("_found"), F.length("_text").cast("bigint")).otherwise(F.col("_row.n_chars")).alias(c)
        return F.col(f"_row.`{c}`")

    return out.select(*[column(c) for c in docs.columns])
