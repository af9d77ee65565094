"""Secret scans in DataFrame operations alone.

Fixed patterns give the base spans: assignments of values to telling names, access keys,
long hexadecimal strings.  What else looks random is found by two Markov models
of characters, one of random strings and one of ordinary words and identifiers: a run of
at least ``LONG`` token characters is a further span if the log-likelihood ratio of its
character pairs is ``LEAST_RATIO`` or more and it touches no base span.

Both models are trained on labelled samples taken from about ``SAMPLE`` distinct texts (those
whose hashes lie below a share that follows from the number of distinct texts, so every task picks its
own): values of base spans count as random, other runs of token characters as ordinary.  Only the
counts of character pairs, whose number the alphabet bounds, come to the driver.  Without a random
sample no spans are added.

Places are counted in code points, ends are exclusive.  The places of a document's matches
come from the lengths of the matches and of what stands between them.

Defined cases: NULL and empty texts have no spans; texts are searched whole; repeated
documents are each searched, and their text is learnt from once; spans of equal start come in the order of
their kinds; an empty table gives an empty table; the output column replaces one of its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which equal starts are listed, with pattern, the group whose length counts, and its least length (fixed values).
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
]
RANDOM = "random"
#: Characters of the models; all others count as the last one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
SYMBOLS = len(ALPHABET) + 1
#: Characters of the shortest run that is judged, and of the shortest that is an ordinary sample.
LONG = 16
ORDINARY = 5
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LONG},}}+"
SAMPLE = 20_000
#: Places over which texts are spread by hash to draw the sample.
PLACES = 1 << 40
LEAST_RATIO = 12.0


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """``start, end, match`` of every match whose group has ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), judged.alias("judged")), lambda x: x["match"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(done, x):
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        found = F.when(F.length(x["judged"]) >= least, F.concat(done["out"], F.array(one))).otherwise(done["out"])
        return F.struct(end.alias("at"), found.alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda done: done["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    return F.transform(
        _matches(text, pattern, group, least),
        lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")),
    )


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns by start, then kind."""
    return F.array_sort(F.concat(*(_spans(text, kind, i, p, g, n) for i, (kind, p, g, n) in enumerate(KINDS))))


def _places(of: Column) -> Column:
    """Each character's place in the alphabet, from 0."""
    characters = F.split(of, "")
    return F.transform(F.filter(characters, lambda c: c != ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(SYMBOLS - 1))


def _pairs(of: Column) -> Column:
    places = _places(of)
    return F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: a * SYMBOLS + b)


def samples(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``random, value``: the labelled strings of about ``sample`` distinct texts."""
    texts = docs.select(F.col(text).alias("text")).where(F.length(text) > 0)
    place = F.pmod(F.xxhash64("text"), F.lit(PLACES))
    n_texts = texts.agg(F.approx_count_distinct(F.xxhash64("text"))).head()[0]
    some = texts.where(place < F.lit(math.ceil(PLACES * min(1.0, sample / max(1, n_texts))))).distinct()
    rest = F.col("text")
    for _, pattern, _, _ in KINDS:
        rest = F.regexp_replace(rest, pattern, " ")

    def random(x):
        value = F.when(x["kind"] == "assign", F.regexp_extract(x["match"], KINDS[0][1], 2)).otherwise(x["match"])
        return F.struct(F.lit(True).alias("random"), value.alias("value"))

    ordinary = F.regexp_extract_all(rest, F.lit(rf"[A-Za-z0-9+/_=-]{{{ORDINARY},}}"), F.lit(0))
    both = F.concat(F.transform(base_spans(F.col("text")), random), F.transform(ordinary, lambda v: F.struct(F.lit(False).alias("random"), v.alias("value"))))
    return some.select(F.explode(both).alias("sample")).select("sample.random", "sample.value")


def log_ratios(rows: DataFrame) -> list[float] | None:
    """For every pair of characters the log of how much likelier the random model holds the second after the first; None without random samples."""
    counts = rows.select("random", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("random", "pair").count().collect()
    tables = {kind: [0.5] * (SYMBOLS * SYMBOLS) for kind in (True, False)}
    for row in counts:
        tables[row["random"]][row["pair"]] += row["count"]
    if not any(row["random"] for row in counts):
        return None
    logs = {}
    for kind, table in tables.items():
        totals = [sum(table[a * SYMBOLS : (a + 1) * SYMBOLS]) for a in range(SYMBOLS)]
        logs[kind] = [math.log(n / totals[i // SYMBOLS]) for i, n in enumerate(table)]
    return [round(a - b, 4) for a, b in zip(logs[True], logs[False], strict=True)]


def train(docs: DataFrame, text: str = "text") -> list[float] | None:
    return log_ratios(samples(docs, text))


def ratio(value: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a string."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    return F.aggregate(_pairs(value), F.lit(0.0), lambda total, pair: total + F.get(table, pair))


def secret_spans(docs: DataFrame, ratios: list[float] | None, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: ``start, order, end, kind, match`` of every span by start, then kind."""
    column = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(out, base_spans(column))
    if ratios is None:
        return found
    runs = F.filter(
        _spans(column, RANDOM, len(KINDS), RUN, 0, LONG),
        lambda x: ~F.exists(F.col(out), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])) & (ratio(x["match"], ratios) >= LEAST_RATIO),
    )
    return found.withColumn(out, F.array_sort(F.concat(F.col(out), runs)))


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Train on the documents and find the spans of all."""
    return secret_spans(docs, train(docs, text), text, out)


def is_kind(kind: str):
    """Whether a span is of this kind."""
    return lambda x: x["kind"] == kind


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every stretch of spans replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(done, x):
        gap = F.substr(text, done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0)))
        fresh = (x["start"] >= done["at"]) & ((x["start"] > done["at"]) | (done["at"] == 0))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.concat(done["out"], gap, F.when(fresh, F.lit(mask)).otherwise("")).alias("out"))

    made = F.aggregate(spans, start, add, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, made).otherwise(text)
