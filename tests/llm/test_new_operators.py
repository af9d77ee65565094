"""Source divergence, fill-in-middle and piecewise hashes against plain Python, on small tables with the awkward cases."""

import hashlib
import random
import re
import tracemalloc
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitecorpus.llm import common, divergence, fill_in_middle, piecewise_hash, quality, queries

RANDOM = random.Random(11)
WORDS = "Alder birch cedar élan façade straße niño oak pine 12 3rd # & token-ring a,b,a re-re ＡＢ 日本語 \x1c x y".split(" ")


def prose(n, seed, gap=" "):
    r = random.Random(seed)
    return gap.join(r.choice(WORDS) + r.choice(["", "", ",", "s", "\n"]) for _ in range(n))


LONG = prose(40_000, 1) + "\n" * 70_000 + "x" * 140_000 + "\n" + "é\n" * 9000 + "-".join(f"part{i % 50}" for i in range(3000))
TEXTS = [None, "", "\n", "\n\n", "a", "ab\n", "abcd", "one\ntwo", "has <S> inside\nx", "x<P\ny>\n<\nM>", prose(60, 2), prose(60, 2), prose(90, 3), prose(400, 4, "\n"), LONG, prose(7, 5), "\r\n line\n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, NULL in any column, and columns with names that the operators use themselves."""
    sources = ["s1", "s2", None, "s1", "ü"]
    rows = [(i * 3, t, ["en", "de", None][i % 3], sources[i % 5], "f", "p") for i, t in enumerate(TEXTS)]
    rows += [(30, TEXTS[10], "en", "s1", None, "p"), (30, TEXTS[10], "en", "s1", None, "p"), (30, prose(20, 9), "en", "s4", "f", None)]
    rows += [(None, prose(50, 6), "en", "s2", "f", "p"), (None, prose(50, 7), "en", "s4", "f", "p"), (None, None, None, None, None, None), (99, "12 # &", "xx", "none", "f", "p"), (100, None, "xx", "other", "f", "p")]
    rows += [(200 + i, prose(30, i), "en", f"s{i % 4}", "f", "p") for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fim string, fingerprint string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, fim string, fingerprint string")


def plain_divergence(rows, min_docs=3, ranks=200):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").translate(fold)))
        counts[lang, source].update(terms)
        docs[lang].update(terms.keys())
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order[:most])]
    return sorted(out)


@pytest.mark.parametrize("held,min_docs", [(24 << 20, 1), (3, 2), (3, 3)])
def test_divergence(docs, held, min_docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    expected = plain_divergence(docs.collect(), min_docs, 5)
    got = sorted(tuple(r) for r in divergence.divergence(docs, min_docs, 5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == expected
    assert {r[2] for r in got} == {"pair", "term"} and any(r[4] == 0 for r in got)


def test_divergence_of_nothing(empty, docs):
    assert divergence.divergence(empty).collect() == []
    with pytest.raises(ValueError):
        divergence.divergence(docs, 4)


def test_documents_of_a_term_are_counted_over_its_chunks(spark):
    """Two documents in each of two chunks, sharing none, one, or both."""
    def kept(*texts):
        frame = spark.createDataFrame([(t, "l", "s") for t in texts], "text string, lang string, source string").repartition(2)
        return {r.term for r in divergence.term_counts(frame, *divergence.numbered_groups(frame)).collect()}

    assert "oak" in kept("oak, x", "oak, y", "oak. z", "oak. w")
    assert "oak" in kept("oak, oak.", "oak, y", "oak. w")
    assert "oak" not in kept("oak, oak.", "oak, oak. y", "w")
    assert kept("oak oak oak", "oak oak", "pine") == set()


def test_long_chunks_are_cut_at_marks():
    texts = [("-".join(["oak"] * 5000) + " oak" + " " + "é" * 500), "", "a oak", " \t", "OAK " + "x" * 65]
    rows = divergence.counted(np.array([7, 7, 7, 7, 2]), pa.array(texts), 1).to_pylist()
    step = 1 << divergence.PARTITION_BITS
    assert sorted(tuple(r.values()) for r in rows) == [
        ("a", 7, 1, 1, 2 * step + 1, None),
        ("oak", 2, 1, 1, 4 * step + 1, None),
        ("oak", 7, 5002, 2, 1, 2 * step + 1),
        ("x" * 65, 2, 1, 1, 4 * step + 1, None),
        ("é" * 500, 7, 1, 1, 1, None),
    ]
    assert divergence.counted(np.array([1]), pa.array([" "]), 0) is None


def plain_form(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("seed,rate,spm", [(7, 100, 50), (1, 60, 0), (2, 0, 50), (3, 100, 100)])
def test_fill_in_middle(docs, empty, seed, rate, spm):
    made = fill_in_middle.fill_in_middle(docs, seed, rate, spm)
    assert sorted(made.columns) == sorted(docs.columns)  # the column named like the result is replaced
    rows = made.select("doc_id", "text", "fim.*", fill_in_middle.restored(F.col("fim.form"), F.col("fim.output")).alias("back")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(r.doc_id, r.text, seed, rate, spm)
        assert r.back == (r.text or "")
    assert fill_in_middle.fill_in_middle(empty).collect() == []


def test_boundaries_of_every_kind():
    kinds = set()
    dense = b"".join(b"\n" if RANDOM.random() < 0.3 else b"x" for _ in range(70_000))
    for data in (b"", b"\n", b"x", b"\n" * 70_000, b"x" * 65_535, b"x" * 65_535 + b"\n", b"x" * 65_536, b"x" * 65_536 + b"\n", dense, b"ab\n" * 30_000, b"x" * 200_000 + b"\ny", dense + b"\n" * 200_000 + b"z"):
        ends = [m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+", data)]
        found = fill_in_middle.Boundaries(data)
        kinds |= {type(c).__name__ for c in found.containers}
        assert len(found) == len(ends)
        for k in {*range(min(50, len(ends))), *RANDOM.sample(range(len(ends)), min(200, len(ends))), *range(max(0, len(ends) - 50), len(ends))}:
            assert found.select(k) == ends[k]
        with pytest.raises(IndexError):
            found.select(len(ends))
    assert kinds == {"ArrayContainer", "BitmapContainer", "RunContainer"}


def test_sentinels_must_be_told_apart(docs):
    for bad in (("aba", "x", "y"), ("<P", "P>", "m"), ("", "a", "b"), ("<P>", "<P>", "<M>"), ("x<P>x", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(docs, sentinels=fill_in_middle.Sentinels(*bad))


def plain_fingerprint(data: bytes) -> str:
    """Byte by byte, one block size after the other."""
    hashes, window = [], [0] * 7
    for c in data:
        window = [c, *window[:6]]
        mixed = 0
        for back, b in enumerate(window):
            mixed ^= b << 5 * back & 0xFFFFFFFF
        hashes.append((sum(b * (8 - back) for back, b in enumerate(window)) + mixed + 1) & 0xFFFFFFFF)

    def letter(chunk):
        total = 0
        for c in reversed(chunk):
            total = (total * piecewise_hash.BASE + (c + 1) * 69_069_069) % piecewise_hash.PRIME
        return chr(piecewise_hash.ALPHABET[total * 0x9E3779B97F4A7C15 % 2**64 >> 58])

    def signature(size, most):
        out, start = "", 0
        for i, h in enumerate(hashes):
            if h and h % size == 0 and len(out) < most - 1:
                out, start = out + letter(data[start : i + 1]), i + 1
        return out + (letter(data[start:]) if start < len(data) else "")

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and sum(1 for h in hashes if h and h % size == 0) < 32:
        size //= 2
    return f"{size}:{signature(size, 64)}:{signature(2 * size, 32)}"


def test_fingerprints(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS if t is not LONG] + [b"a" * 5000, b"ab" * 4000, bytes(RANDOM.randrange(256) for _ in range(30_000)), prose(3000, 8).encode()]
    expected = [plain_fingerprint(t) for t in texts]
    assert piecewise_hash.fingerprints_of(texts) == expected
    assert expected[0] == "3::"
    for block in (64, 4096):  # texts of many blocks
        monkeypatch.setattr(piecewise_hash, "GROUP_BYTES", block)
        monkeypatch.setattr(piecewise_hash, "_TABLES", {})
        assert [piecewise_hash._of_group([t])[0] for t in texts] == expected


def plain_likeness(a, b):
    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            above, row = row, [i + 1]
            for j, d in enumerate(y):
                row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (c != d)))
        return row[-1]

    def alike(*both):
        return 1 - sum(edits(x, y) for x, y in both) / max(1, sum(max(len(x), len(y)) for x, y in both))

    if a == b:
        return 1.0
    sa, sb = int(sa), int(sb)
    return alike((a1, b1), (a2, b2)) if sa == sb else alike((a1, b2)) if sa == 2 * sb else alike((a2, b1)) if sb == 2 * sa else 0.0


@pytest.mark.parametrize("partitions", ["1", "2", "7"])
def test_edited_pairs(spark, docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        some = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 9000)
        found = piecewise_hash.edited_pairs(some)
        rows = found.select("*", piecewise_hash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near"), piecewise_hash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("other")).collect()
        order = some.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text))
    expected = []
    for one, two in zip(order, order[1:] + order[:1], strict=True):
        n = len(one.text) // 4
        edited = one.text[: len(one.text) - n] + two.text[:n]
        prints = [plain_fingerprint(t.encode()) for t in (one.text, edited, two.text)]
        near = [round(plain_likeness(prints[0], p), 9) for p in prints[1:]]
        expected.append((one.doc_id, len(one.text), hashlib.sha256(edited.encode()).hexdigest(), *prints, *near))
    assert sorted(((*r[:6], round(r.near, 9), round(r.other, 9)) for r in rows), key=repr) == sorted(expected, key=repr)


def test_few_documents_and_none(spark, empty, docs):
    assert piecewise_hash.edited_pairs(empty).collect() == []
    assert piecewise_hash.fingerprints(empty).collect() == []
    alone = piecewise_hash.edited_pairs(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in alone] == [(5, 8, hashlib.sha256(b"abcdefab").hexdigest())]
    made = piecewise_hash.fingerprints(docs)
    assert sorted(made.columns) == sorted(docs.columns)
    of = {r.text or "": r.fingerprint for r in made.collect()}
    assert of[""] == "3::" and of[TEXTS[12]] == plain_fingerprint(TEXTS[12].encode())


def test_an_edit_changes_letters_near_it_only():
    text = prose(2000, 12)
    at = text.index(" ", 4000)
    one, two = piecewise_hash.fingerprints_of([text.encode(), (text[:at] + " inserted" + text[at:]).encode()])
    other = piecewise_hash.fingerprints_of([prose(2000, 13).encode()])[0]
    assert plain_likeness(one, two) > 0.9
    assert plain_likeness(one, other) < 0.35


def test_query_bodies(spark, docs, tmp_path):
    """The registered queries over a small table, against the plain versions."""
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    assert sorted(tuple(r) for r in queries.op11_divergence(spark, str(tmp_path)).collect()) == plain_divergence(rows)

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    forms = {r.doc_id: plain_form(r.doc_id, r.text) for r in rows}
    for r in queries.op12_fill_in_middle(spark, str(tmp_path)).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == forms[r.doc_id][:4]
        assert (r.output_sha256, r.restored_sha256) == (sha(forms[r.doc_id][4]), sha(next(x.text or "" for x in rows if x.doc_id == r.doc_id)))
    rows.sort(key=lambda r: r.doc_id)
    after = {a.doc_id: (a.text or "", b.text or "") for a, b in zip(rows, rows[1:] + rows[:1], strict=True)}
    for r in queries.op13_piecewise_hash(spark, str(tmp_path)).collect():
        text, following = after[r.doc_id]
        n = len(text) // 4
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(text[: len(text) - n] + following[:n]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint)


def test_a_worker_keeps_the_tables_of_one_operator():
    """What one operator keeps goes when another begins, so a worker never holds the tables of two stages."""

    class Table:
        pass

    first = common.kept("one", Table)
    gone = weakref.ref(first)
    assert common.kept("one", Table) is first
    del first
    second = common.kept("two", Table)
    assert gone() is None and common.kept("two", Table) is second
    gone = weakref.ref(second)
    del second
    common.drop_kept()
    assert gone() is None


def test_quality_makes_arrays_of_few_texts_at_once():
    texts = [("word%d and more " % i) * 130 for i in range(1200)]
    texts[7:9] = ["", "ends in a break\n"]
    weights = np.random.default_rng(5).normal(0, 1, (quality.FAMILIES, 1 << quality.BITS)).astype(np.float32)
    model = quality.Model(weights, 0.0, 1.0, 0.0)
    whole = [quality._scored(quality.Texts(texts[a:b]), model) for a, b in common.groups([t.encode() for t in texts])]
    whole = [np.concatenate(x) for x in zip(*whole, strict=True)]
    quality._scored(quality.Texts(texts[:2]), model)  # what is made once
    tracemalloc.start()
    parts = [quality._scored(t, model) for t in quality._slices(pa.array(texts))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i, column in enumerate(whole):
        assert np.array_equal(np.concatenate([p[i] for p in parts]), column)
    assert peak < 48 << 20, peak
