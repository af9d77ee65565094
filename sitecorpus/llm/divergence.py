"""How the terms of a source differ from those of its language.

Terms are counted by chunk factorization.  Each document is folded (A-Z) and cut at white
space, and its chunks are counted; a task adds up the counts of its documents.  Each
globally distinct chunk is then cut into terms once, and its terms are joined back to its
counts.  A chunk longer than ``LONGEST`` bytes is cut at all ASCII marks beforehand, so
that no chunk carries many terms.

A term counts for a language if it occurs in ``min_docs`` (up to 3) of its documents.  To
decide that, a chunk's row carries in how many documents of a group it is and, for two at
most, the numbers of these documents.  A term is in three documents if one of its chunks
is, or if the numbers over all its chunks are more than two different ones, which their
sums tell: ``(x - least) * (greatest - x)`` is 0 for the least and greatest, and above 0
between.  Groups share no documents, so a language's documents are the sum over its groups.

``p`` of a term in a group, and ``q`` in the language, are smoothed shares of a billion, and
``(p - q) ** 2 / q`` is the term's part of their divergence.  The sum over all kept terms for two
sources needs only the terms that both have: the rest follows from what each one has alone,
and from the share of a term that does not occur.  Whole-number arithmetic throughout; 64
bits hold it up to 9e15 occurrences and 5e8 kept terms of a language, and Spark stops with
an error beyond.

Defined cases: NULL text, language and source are empty strings; every row is a document, so
repeated rows count as often as they stand there and ids are not read; texts are read whole;
equal values are ranked by item; groups without terms are reported against the other
sources; a language without kept terms gives 0; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.llm.common import ship

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MARKS = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+")
LONGEST = 64
#: Bytes of text that a worker counts at once; a longer text is counted alone.
HELD = 24 << 20
#: Bits of a document's number that hold its partition; the others count the rows there.
PARTITION_BITS = 24
ALL = 1_000_000_000

ROWS = "chunk string, place long, n long, docs long, one long, two long"


def _pieces(chunks: pa.Array, codes: np.ndarray, docs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same tokens (a code among ``chunks``, and a document), with long chunks cut at ASCII marks."""
    long = np.flatnonzero(pc.greater(pc.binary_length(chunks), LONGEST).to_numpy(zero_copy_only=False))
    if not len(long):
        return chunks, codes, docs
    cuts = [[p for p in MARKS.split(chunks[int(i)].as_py()) if p] for i in long]
    whole = pa.concat_arrays([chunks, pa.array([p for c in cuts for p in c], chunks.type)]).dictionary_encode()
    same = whole.indices.to_numpy()
    lengths = np.ones(len(chunks), np.int64)
    lengths[long] = [len(c) for c in cuts]
    starts = np.arange(len(chunks))
    starts[long] = len(chunks) + np.cumsum([0] + [len(c) for c in cuts[:-1]])
    times = lengths[codes]
    inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return whole.dictionary, same[np.repeat(starts[codes], times) + inside], np.repeat(docs, times)


def counted(places: np.ndarray, texts: pa.Array, first: int) -> pa.RecordBatch | None:
    """Chunks of some documents, by place: occurrences, documents, and which documents where there are two at most.

    The rows are numbered from ``first`` in steps of a partition's place.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().cast(pa.binary()).dictionary_encode()
    docs = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    chunks, codes, docs = _pieces(coded.dictionary, coded.indices.to_numpy(), docs)
    full = pc.not_equal(chunks, b"").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    codes, docs = codes[full], docs[full]
    if not len(codes):
        return None
    kinds, place = np.unique(places, return_inverse=True)
    # One sort brings together the tokens of a place and chunk, document by document.
    tokens = np.sort((place[docs] * len(chunks) + codes) * len(texts) + docs)
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    times = np.diff(np.append(starts, len(tokens)))
    groups, docs = np.divmod(tokens[starts], len(texts))
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    n_docs = np.diff(np.append(starts, len(groups)))
    few = n_docs <= 2
    number = (docs << PARTITION_BITS) + first
    place, codes = np.divmod(groups[starts], len(chunks))
    return pa.RecordBatch.from_arrays(
        [
            chunks.take(pa.array(codes)).cast(pa.string()),
            pa.array(kinds[place]),
            pa.array(np.add.reduceat(times, starts)),
            pa.array(n_docs),
            pa.array(number[starts], mask=~few),
            pa.array(number[starts + n_docs - 1], mask=n_docs != 2),
        ],
        ["chunk", "place", "n", "docs", "one", "two"],
    )


def _counted(batches):
    first, held, size = TaskContext.get().partitionId(), [], 0
    if first >> PARTITION_BITS:
        raise ValueError(f"more than {1 << PARTITION_BITS} partitions")

    def done():
        nonlocal first, held, size
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if size else None
        if whole is not None and (rows := counted(whole.column(0).to_numpy(), whole.column(1), first)) is not None:
            yield from (rows.slice(at, 50_000) for at in range(0, rows.num_rows, 50_000))
        first += sum(b.num_rows for b in held) << PARTITION_BITS
        held, size = [], 0

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            some = batch.slice(at, 200)
            more = pc.sum(pc.binary_length(some.column(1))).as_py() or 0
            if size and size + more > HELD:
                yield from done()
            held.append(some)
            size += more
    yield from done()


def numbered_groups(df: DataFrame) -> tuple[DataFrame, Column]:
    """``lang, source, place`` of every group, and the expression of ``place``: a hash that no two groups share."""
    groups = cut(df.select("lang", "source").distinct(), "groups")
    seed = 0
    while True:
        place = F.xxhash64(F.lit(seed), "lang", "source")
        numbered = groups.withColumn("place", place)
        if numbered.groupBy("place").count().where(F.col("count") > 1).isEmpty():
            return numbered, place
        seed += 1


def chunk_counts(df: DataFrame, place: Column) -> DataFrame:
    """``chunk, place, n, docs, one, two``: occurrences and documents of each chunk in each group; the documents by number, if two at most."""
    ship(df.sparkSession)
    rows = df.select(place.alias("place"), "text").mapInArrow(_counted, ROWS)
    # Dealt by chunk, so that a chunk's groups are added up in one place without another exchange.
    return (
        rows.repartition("chunk")
        .groupBy("chunk", "place")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("one").alias("one"), F.max(F.coalesce("two", "one")).alias("two"))
    )


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``chunk, term, times``: the terms of each distinct chunk."""
    return (
        chunks.select("chunk")
        .distinct()
        .select("chunk", F.explode(F.regexp_extract_all(F.col("chunk"), F.lit(TERM), F.lit(0))).alias("term"))
        .groupBy("chunk", "term")
        .agg(F.count("*").alias("times"))
    )


def term_counts(df: DataFrame, groups: DataFrame, place: Column, min_docs: int = 3) -> DataFrame:
    """``lang, source, term, n, lang_n``: occurrences, in each group and its language, of the terms that the language keeps (a written table)."""
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs is from 1 to 3")
    chunks = cut(chunk_counts(df, place), "chunks")
    rows = chunks.join(chunk_terms(chunks), "chunk")

    def exact(name: str) -> Column:
        return F.when(F.col("docs") <= 2, F.col(name).cast("decimal(19,0)"))

    of_group = rows.groupBy("place", "term").agg(
        F.sum(F.col("n") * F.col("times")).alias("n"),
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("docs") <= 2, F.col("one"))).cast("decimal(19,0)").alias("least"),
        F.max(F.when(F.col("docs") <= 2, F.col("two"))).cast("decimal(19,0)").alias("greatest"),
        F.count(F.when(F.col("docs") <= 2, 1)).cast("decimal(18,0)").alias("number"),
        F.sum(exact("one") + exact("two")).alias("sum"),
        F.sum(exact("one") * exact("one") + exact("two") * exact("two")).alias("squares"),
    )
    between = (F.col("least") + F.col("greatest")) * F.col("sum") - F.col("squares") - 2 * F.col("number") * F.col("least") * F.col("greatest")
    docs = F.when((F.col("docs") > 2) | (between > 0), 3).when(F.col("least") < F.col("greatest"), 2).otherwise(1)
    of_lang = Window.partitionBy("lang", "term")
    return cut(
        of_group.select("place", "term", "n", docs.alias("docs"))
        .join(groups, "place")
        .select("lang", "source", "term", "n", F.sum("n").over(of_lang).alias("lang_n"), F.sum("docs").over(of_lang).alias("lang_docs"))
        .where(F.col("lang_docs") >= min_docs)
        .drop("lang_docs"),
        "term_counts",
    )


def _share(count: Column, total: Column) -> Column:
    """1 plus the smoothed share in billionths, rounded down: a long division by thousands, which stays exact in 64 bits."""
    above, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        above = above * 1000
        out, above = out * 1000 + F.call_function("div", above, total), above % total
    return out + 1


def _part(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(df: DataFrame, min_docs: int = 3, ranks: int = 200, smoothing: int = 1, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: each group against the other sources of its language, and its most telling terms."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    docs = df.select(*texts)
    found, place = numbered_groups(docs)
    counts = term_counts(docs, found, place, min_docs)
    group_totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    lang_totals = counts.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    groups = cut(
        found.select("lang", "source")
        .join(group_totals, ["lang", "source"], "left")
        .join(lang_totals, "lang", "left")
        .na.fill(0, ["total", "own", "lang_total", "kept"])
        .withColumn("of", F.col("total") + smoothing * F.col("kept"))
        .withColumn("lang_of", F.col("lang_total") + smoothing * F.col("kept"))
        .withColumn("none", F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), F.greatest("of", F.lit(1))))),
        "group_totals",
    )
    shares = counts.join(groups.select("lang", "source", "of", "lang_of", "none"), ["lang", "source"]).select(
        "lang", "source", "term", "none", _share(F.col("n"), F.col("of")).alias("p"), _share(F.col("lang_n"), F.col("lang_of")).alias("q")
    )

    telling = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _part(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    telling = telling.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    # Terms that both sources have: their part, less what the sums below count for each of them.
    side = shares.select("lang", "term", "source", "p", "none")
    a, b = side.alias("a"), side.alias("b")
    pa_, za, pb, zb = F.col("a.p"), F.col("a.none"), F.col("b.p"), F.col("b.none")
    met = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    both = met.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("x"), F.col("b.source").alias("y")).agg(
        F.sum(_part(pa_, pb) - _part(pa_, zb) - _part(za, pb) + _part(za, zb)).alias("one"),
        F.sum(_part(pb, pa_) - _part(pb, za) - _part(zb, pa_) + _part(zb, za)).alias("two"),
    )
    turned = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("one").alias("shared")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("two").alias("shared"))))
    shared = both.select("lang", turned.alias("pair")).select("lang", "pair.*")
    # How many terms of a source have each share: its terms against the absence of each in another source, and the reverse.
    spread = cut(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "spread")
    other = groups.where(F.col("kept") > 0).select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    facing = spread.join(other, "lang").where(F.col("source") != F.col("other"))
    alone = facing.groupBy("lang", "source", "other").agg(
        F.sum(_part(F.col("p"), F.col("other_none")) * F.col("terms")).alias("mine"),
        F.sum(_part(F.col("other_none"), F.col("p")) * F.col("terms")).alias("theirs"),
    )
    pairs = (
        groups.select("lang", F.col("source").alias("a"), F.col("none").alias("za"), F.col("own").alias("own_a"), "kept")
        .join(groups.select("lang", F.col("source").alias("b"), F.col("none").alias("zb"), F.col("own").alias("own_b")), "lang")
        .where(F.col("a") != F.col("b"))
        .join(shared, ["lang", "a", "b"], "left")
        .join(alone.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), "mine"), ["lang", "a", "b"], "left")
        .join(alone.select("lang", F.col("source").alias("b"), F.col("other").alias("a"), "theirs"), ["lang", "a", "b"], "left")
    )
    rest = (F.col("kept") - F.col("own_a") - F.col("own_b")) * F.coalesce(_part(F.col("za"), F.col("zb")), F.lit(0))
    value = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("shared", "mine", "theirs")), rest)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(telling)
