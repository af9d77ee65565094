"""Each operator against brute force, on small tables with the awkward cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitecorpus.llm import byte_bpe, common, decontaminate, jaccard_join, language, orc_ids, quality, queries, recurrent_lm, secrets, token_counts, warc
from sitecorpus.llm.components import components

RANDOM = random.Random(5)
VOCABULARY = "alder birch cedar Dogwood élan façade größe über niño über, oak. pine; 12 3rd # & token".split()


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "x", "yz"]) for _ in range(n))


LONG = prose(30_000, 1) + "\n" + "a" * 70_000
ODD = "a  b　c d \n\n e\t<|endoftext|>  it's 'RE ½² \U0001f600 é Σ İ\x1c\x85"
TEXTS = [None, "", " \n", "x", prose(80, 2), prose(80, 2), prose(60, 3) + "\n" + prose(60, 3), ODD, LONG, "日本語の文章です", prose(9, 4), prose(200, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, NULL ids and texts, and columns with names that the operators use themselves."""
    rows = [(i, t, "l", i) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "l", 0), (None, prose(70, 6), None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, ids string, n_tokens long")


def pairs(df, *columns):
    return sorted(((r[0], *r[1:]) for r in df.select(*columns).collect()), key=repr)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_byte_bpe(docs, empty):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    done = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern)
    got = pairs(done, "doc_id", "ids", "decoded")
    want = sorted(((i, bytearray(np.array(library.encode_ordinary(t), "<u4").tobytes()), bytearray(t.encode())) for i, t in texts_of(docs)), key=repr)
    assert got == want
    assert byte_bpe.encode(empty, path, pattern).count() == 0


def test_byte_bpe_neighbours():
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = byte_bpe.Codec(tokens, byte_bpe.halves(tokens), public_tokenizers.PATTERN, words=4)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for _ in range(400):
        text = "".join(RANDOM.choice(["th", "e", "a", "s", " ", "ing", "é", "\n", "0", "!"]) for _ in range(60))
        assert np.frombuffer(codec.encode(text.encode()), "<u4").tolist() == library.encode_ordinary(text)


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = pairs(token_counts.token_counts(docs, path, size=5), "doc_id", "n_tokens")
    assert got == sorted(((i, len(library.encode(t, add_special_tokens=False))) for i, t in texts_of(docs)), key=repr)
    assert token_counts.token_counts(empty, path).count() == 0


def test_summaries_keep_the_heavy_words():
    counts = collections.Counter({"a": 50, "b": 30, "c": 2, "d": 1})
    assert set(token_counts.pruned(counts, 2)) == {"a", "b"}


def test_orc_ids(spark, docs, empty, tmp_path):
    name = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(name)
    orc_ids.write_ids(docs, name, f"{tmp_path}/ids", 2)
    read = orc_ids.read_ids(spark, f"{tmp_path}/ids")
    rows = sorted(texts_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, before = [], 0
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert pairs(read, "doc_id", "start", "n_tokens", orc_ids.ids_crc32()) == sorted(want, key=repr)
    assert [r.doc_id for r in orc_ids.ids_of(spark, f"{tmp_path}/ids", 9).collect()] == [9]
    orc_ids.write_ids(empty, name, f"{tmp_path}/none", 2)


def test_contamination(spark, docs, empty):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", prose(200, 5).lower())
    items = [(1, " ".join(words[20:40])), (2, "PINE " + " ".join(words[50:61])), (3, " ".join(words[100:104])), (4, None), (5, ""), (6, " ".join(words[20:40])), (7, "never seen before")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for k in range(max(1, len(w) - 9)) if w else ():
            wanted[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t in texts_of(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
        hit, ids = set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if found := wanted.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        want.append((i, len(w), len(hit), sorted(ids)))
    for block in (200_000, 12):  # one block, and several that merge
        found = decontaminate.contamination(docs, bench, block=block)
        n_hit = F.aggregate("contamination.spans", F.lit(0), lambda n, x: n + x["end"] - x["start"])
        assert pairs(found, "doc_id", "contamination.n_words", n_hit, "contamination.item_ids") == sorted(want, key=repr)
        assert found.columns == [*docs.columns, "contamination"]
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.where(F.size("contamination.spans") > 0).count() == 0


def test_quality(spark, docs, empty):
    good = [(100 + i, prose(120, 50 + i)) for i in range(24)]
    bad = [(200 + i, " ".join(w + "%%%" for w in prose(120, 80 + i).upper().split())) for i in range(24)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in good + bad] + [(100, None), (None, 1), (999, 0)], "doc_id long, quality int")
    model = quality.train(rows, labels)
    fresh = spark.createDataFrame([(1, prose(120, 7)), (2, " ".join(w + "%%%" for w in prose(120, 8).upper().split()))], "doc_id long, text string")
    judged = {r.doc_id: r.q for r in quality.score(fresh, model, out="q").collect()}
    assert judged[1].kept and not judged[2].kept and not judged[2].base_failed
    want = []
    for i, t in texts_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = pairs(quality.score(docs, None, out="q"), "doc_id", *(f"q.{c}" for c in quality.COUNTS), "q.base_failed")
    assert got == sorted(want, key=repr)
    assert quality.train(docs, labels.limit(0)) is None and quality.score(empty, model).count() == 0


def test_warc(spark, tmp_path):
    page = "<p>" + prose(60, 9) + "</p>"
    rows = [(i, f"http://a/{i}", page if i % 3 == 0 else f"<p>{i}</p>" * (1 + i % 40)) for i in range(200)]
    rows += [(500, None, None), (501, "u\nv", ""), (502, "x", "short"), (503, "x", "short"), (3, "again", page), (None, "n", page), (504, "long", LONG), (505, "b", "P*M\x18\0\0\0\0" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, f"{tmp_path}/w")
    least = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            least[h] = min(i, least.get(h, i))
    want = []
    for i, _, h in rows:
        h = h or ""
        first = least.get(h) if len(h.encode()) >= 100 else None
        again = first is not None and first != i
        want.append((None if i is None else str(i), len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", str(first) if again else None))
    read = warc.read_archives(spark, f"{tmp_path}/w")
    assert pairs(read, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert read.where("record_type = 'response' and sha2(payload, 256) != payload_digest").count() == 0
    archives = [bytes(r[0]) for r in spark.read.format("binaryFile").load(f"{tmp_path}/w").select("content").collect()]
    assert all(a[:4] == b"\x5d\x2a\x4d\x18" for a in archives if len(a) > 50_000)
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def test_near_duplicates(spark, docs, empty):
    r = random.Random(11)
    rows = []
    for base in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(120)]
        for _ in range(r.randint(1, 6)):
            near = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                near[r.randrange(len(near))] = f"v{r.randrange(5000)}"
            rows.append((len(rows), " ".join(near)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One, two!"), (1004, LONG)]
    sets = shingle_sets([(i, t or "") for i, t in rows])
    linked = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                linked[a].add(b)
    group = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            if (x := todo.pop()) not in group:
                group[x] = i
                todo += linked[x]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs(found, "doc_id", "group_id", "n_links") == sorted(((i, group[i], len(linked[i])) for i in sets), key=repr)
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert jaccard_join.near_duplicates(docs).count() == docs.count()


def test_large_buckets_split_or_merge(spark, monkeypatch):
    """Groups beyond the limits of buckets and blocks keep every link."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(25)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = shingle_sets(rows)
    for row in found:
        want = sum(b != row.doc_id and 5 * len(sets[row.doc_id] & sets[b]) >= 4 * len(sets[row.doc_id] | sets[b]) for b in sets)
        assert (row.group_id, row.n_links) == (0, want)


def test_recall_where_passages_are_hot(spark, monkeypatch):
    """Documents made of passages that half of the others hold too: buckets are split beyond the length the first runs are made for, and the recall of brute force's links holds."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 2)
    r, met, lengths = random.Random(8), jaccard_join._met, []
    monkeypatch.setattr(jaccard_join, "_met", lambda *a: lengths.append((met(*a), a[3])) or lengths[-1][0])
    passages = [[f"p{i}w{k}" for k in range(12)] for i in range(40)]
    texts = [[w for i in sorted(r.sample(range(40), 20)) for w in passages[i]] for _ in range(300)]
    texts += [words[: round(len(words) * 0.81)] for words in texts]
    sets = shingle_sets(rows := [(i, " ".join(words)) for i, words in enumerate(texts)])
    linked = {i: sum(5 * len(x & y) >= 4 * len(x | y) for j, y in sets.items() if j != i) for i, x in sets.items()}
    assert sum(linked.values()) >= 600
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(row.n_links for row in found) >= jaccard_join.RECALL * sum(linked.values())
    assert all(row.n_links <= linked[row.doc_id] for row in found)
    deepest = max(depth for (_, depth), _ in lengths)
    assert deepest > jaccard_join.LENGTH and sum(len(numbers) for _, numbers in lengths) >= jaccard_join.runs(jaccard_join.RECALL, deepest)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(30, 40), (50, 40), (60, 60)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(2, 21)}, 40: 30, 50: 30}


def test_secrets(spark, docs, empty):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    extra = [(i, f"é {prose(20, i)} Token = \"{h}\" then {h} and AKIA{h.upper()[:18]} password: abc secret=token:abcdef") for i, h in enumerate(hexes)]
    extra += [(90, "key aZ9xQ2rT7yLmP4wB8sKd1fGh end"), (91, "alderalderalderalder")]
    rows = spark.createDataFrame(extra, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    kinds = [(k, re.compile(p.replace("{24,}", "+"), re.A), g, n) for k, p, g, n in secrets.KINDS]
    want = []
    for i, t in texts_of(rows):
        spans = sorted((m.start(), o, m.end(), k) for o, (k, p, g, n) in enumerate(kinds) for m in p.finditer(t) if len(m[g]) >= n)
        want.append((i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))
    found = secrets.scan(rows)
    base = F.filter("secrets", lambda x: x["kind"] != secrets.RANDOM)
    assert pairs(found, "doc_id", secrets.joined(base)) == sorted(want, key=repr)
    random_spans = {r.doc_id: r.n for r in found.select("doc_id", F.size(F.filter("secrets", secrets.is_kind(secrets.RANDOM))).alias("n")).collect()}
    assert random_spans[91] == 0
    masked = {r.doc_id: r.t for r in found.select("doc_id", secrets.masked(F.col("text"), F.col("secrets")).alias("t")).collect()}
    assert not any(h in (masked[i] or "") for i, h in enumerate(hexes)) and masked[91] == extra[-1][1]
    assert secrets.scan(empty).count() == 0


def test_language(spark, docs, empty):
    r = random.Random(2)
    made = {"xx": "ba be bi bo bu".split(), "yy": "stra gro kli pfu".split()}
    rows = [(i, " ".join("".join(r.choices(made[lang], k=3)) for _ in range(40)), lang) for i, lang in enumerate(["xx", "yy"] * 20)] + [(99, None, "xx"), (98, "12 !", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(train, public_tokenizers.path("piece_bpe_32k.model"))
    test = spark.createDataFrame([(1, "babebi bobubo", 0), (2, "strapfu klikli", 0), (3, None, 0), (4, "12 34", 0)], "doc_id long, text string, language int")
    found = {x.doc_id: x.language.lang_pred for x in language.predict(test, model).collect()}
    assert found == {1: "xx", 2: "yy", 3: "und", 4: "und"}
    assert language.predict(docs, model).count() == docs.count() and language.predict(empty, model).count() == 0
    nothing = language.train(train.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert {x.language.lang_pred for x in language.predict(test, nothing).collect()} == {"und"}


def test_language_sums_over_all_cuts():
    model = language.fit(["▁", "a", "b", "ab", "▁a", "▁ab"], [("x", "ab", 3), ("x", "ba", 1)])
    p = dict(zip(["▁", "a", "b", "ab", "▁a", "▁ab"], model.table[:, 0], strict=False))
    want = p["▁ab"] + p["▁"] * p["ab"] + p["▁a"] * p["b"] + p["▁"] * p["a"] * p["b"]
    assert math.isclose(model.word_logs(["ab"])[0, 0], math.log(want))


@pytest.mark.parametrize("frequent", [1_000_000, 8])
def test_recurrent_lm_base(docs, empty, frequent, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "FREQUENT", frequent)
    held = F.col("doc_id") % 3 == 2
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    rows = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), None]) for i, t in texts_of(docs)]
    counts = collections.Counter(w for i, words in rows if i is None or i % 3 != 2 for w in words)
    total, types = sum(counts.values()), len(counts)
    want = sorted(((i, len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), 4)) for i, w in rows), key=repr)
    found = recurrent_lm.score(docs, held)
    got = pairs(found, "doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4))
    assert got == want
    assert found.where("score IS NULL OR score >= 0").count() == 0
    assert recurrent_lm.score(empty, held).count() == 0


def test_recurrent_lm_gradients():
    """The backward pass against differences."""
    class Words:
        head_n = np.ones(recurrent_lm.HEAD)
        tail_sums = np.ones(recurrent_lm.TAIL_CLASSES)

    p = {k: v.astype(np.float64) for k, v in recurrent_lm.start(Words).items()}
    r = np.random.default_rng(1)
    targets = r.integers(0, recurrent_lm.HEAD + recurrent_lm.TAIL_CLASSES, (3, 5))
    before = np.concatenate([np.zeros((3, 1), int), targets[:, :-1]], axis=1)
    state = np.zeros((3, recurrent_lm.UNITS))
    _, g, _ = recurrent_lm.gradients(p, before, targets, state)
    for name in p:
        flat = p[name].reshape(-1)
        place = int(np.argmax(np.abs(g[name])))
        at, step = flat[place], 1e-5
        flat[place] = at + step
        up = recurrent_lm.gradients(p, before, targets, state)[0]
        flat[place] = at - step
        down = recurrent_lm.gradients(p, before, targets, state)[0]
        flat[place] = at
        assert abs((up - down) / (2 * step) - g[name].reshape(-1)[place]) < 1e-2 * max(1, abs(g[name].reshape(-1)[place]))


def test_recurrent_lm_is_a_distribution():
    """One step's probabilities of all classes, and of all members of a class, sum to one."""
    class Words:
        head_n = np.arange(1.0, recurrent_lm.HEAD + 1)
        tail_sums = np.ones(recurrent_lm.TAIL_CLASSES)

    p = recurrent_lm.start(Words)
    total = sum(math.exp(recurrent_lm.log_likelihoods(p, np.array([i]), np.array([1]))[0]) for i in range(recurrent_lm.HEAD + recurrent_lm.TAIL_CLASSES))
    assert abs(total - 1) < 1e-4


def test_recurrent_lm_fits_on_every_document(spark):
    """The rounds together read each training token once, also where rows repeat a text."""
    rows = [(i, prose(20 + i % 7, i)) for i in range(60)] + [(i, prose(30, 1)) for i in range(100, 130)] + [(None, prose(9, 2)), (None, None), (5, "")]
    learnt = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary = recurrent_lm.Vocabulary(recurrent_lm.counts(learnt))
    assert recurrent_lm.train(learnt, vocabulary)[1] == vocabulary.total


def test_recurrent_lm_trains_all_frequent_tokens(spark):
    """What is seen often enough has an input and a member vector of its own, and the fit moves them."""
    words = [f"{chr(97 + i % 26)}{i}" for i in range(2000)]
    texts = [" ".join(random.Random(i).sample(words, len(words)) + [f"once{i}"]) for i in range(recurrent_lm.LEAST)]
    learnt = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    vocabulary = recurrent_lm.Vocabulary(recurrent_lm.counts(learnt))
    ids, _, _, sizes = vocabulary.sequence([t.encode() for t in texts])
    p, (made, _) = recurrent_lm.start(vocabulary), recurrent_lm.train(learnt, vocabulary)
    side = len(p["members"])
    frequent = np.unique(ids[ids < side * side])
    assert len(frequent) >= 2001 and vocabulary.head_n.sum() >= 2001 * recurrent_lm.LEAST
    assert (made["inputs"] != p["inputs"]).any(axis=1)[frequent].all()
    assert (made["members"] != p["members"]).any(axis=2).ravel()[frequent].all()
    assert abs(vocabulary.head_n.sum() + (vocabulary.tail_sums.sum() - (vocabulary.types - (vocabulary.head_n > 0).sum())) - vocabulary.total) < 1e-6
    assert (recurrent_lm.log_likelihoods(made, ids, sizes) < 0).all()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_hashes_tell_regular_words_apart(spark, empty):
    """A string of two letters that alternates by bit counts and its complement, at lengths where polynomials modulo 2 ** 64 meet."""
    for size in (1024, 2048, 4096):
        one = "".join("ab"[i.bit_count() % 2] for i in range(size))
        two = one.translate(str.maketrans("ab", "ba"))
        for alphabet in (common.PLAIN, common.SPACED):
            _, _, _, _, hashes = alphabet.of_texts([f"{one} {two} {one}".encode()])
            assert hashes[0] == hashes[2] != hashes[1]
        other = f"{one} {one} {two} {one} {two} {two}"
        counts = quality.Texts([other, f"{one} x y {one} x y"]).counts()
        assert counts["n_repeat_words"].tolist() == [0, 6]
        left, right = jaccard_join.shingles([f"{one} {one} {one} {one} {one}".encode(), f"{two} {one} {one} {one} {one}".encode()])
        assert len(left) == len(right) == 1 and left[0] != right[0]


def test_hashes_equal_where_words_are_equal():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 100]).encode() for i in range(0, 4000, 100)]
    hashes = [h for t in texts for h in common.PLAIN.of_texts([t])[4].tolist()]
    assert hashes == common.PLAIN.of_texts(texts)[4].tolist()
    known = dict(zip(words, hashes, strict=True))
    assert [known[w] for w in words] == hashes and len(set(known.values())) == len(known)
    big = ("z" * (3 << 20)).encode()
    assert common.SPACED.of_texts([b"q " + big])[4][1] == common.SPACED.of_texts([big])[4][0]


def test_secret_samples_are_drawn_by_every_task(spark):
    """One text on many rows is one text of the sample, and no task gets the sample of all."""
    rows = [(i, "token = q8Zr2LmX0pVt7Kd") for i in range(5000)] + [(5000 + i, f"word{i} plain text secret = aB3{i}xZ9qW") for i in range(400)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    all_of_them = secrets.samples(docs, sample=10_000)
    assert all_of_them.where("random").count() == 401
    plan = all_of_them._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan
    few = secrets.samples(docs, sample=100).where("random").count()
    assert 50 < few < 160
    assert secrets.train(docs.limit(0)) is None


def test_language_sums_over_all_cuts_of_long_words():
    """Against the plain sum in exact fractions, at lengths on both sides of every border."""
    pieces = ["▁", "a", "b", "ab", "ba", "aab", "▁a", "babab"]
    rng = random.Random(3)
    table = np.array([[rng.random() / 10 for _ in range(2)] for _ in pieces] + [[1e-7] * 2, [0.0] * 2])
    model = language.Model(pieces, ["x", "y"], table)
    words = ["".join(rng.choice("abc" if n % 3 else "ab") for _ in range(n)) for n in (1, 5, 28, 29, 30, 31, 39, 40, 50, 100, 101, 400)]
    got = model.word_logs(words)
    for word, row in zip(words, got, strict=True):
        for lang in range(2):
            ways = [Fraction(1)] + [Fraction(0)] * (len(word) + 1)
            marked = "▁" + word
            for j in range(1, len(marked) + 1):
                for i in range(max(0, j - 5), j):
                    piece = marked[i:j]
                    if piece in pieces:
                        ways[j] += ways[i] * Fraction(table[pieces.index(piece), lang])
                    elif j == i + 1:
                        ways[j] += ways[i] * Fraction(1e-7)
            want = math.log(ways[-1].numerator) - math.log(ways[-1].denominator)
            assert row[lang] == pytest.approx(want, rel=1e-9)
    one_by_one = np.concatenate([model.word_logs([w]) for w in words])
    assert np.allclose(got, one_by_one, rtol=1e-12)


def test_long_words_in_several_windows(monkeypatch):
    pieces = ["▁", "a", "b", "ab", "▁a", "bba"]
    table = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.3, 0.2], [0.1, 0.1], [0.05, 0.3], [1e-7, 1e-7], [0, 0]])
    words = ["ab" * 60 + "c", "abba" * 100, "b" * 35]
    whole = language.Model(pieces, ["x", "y"], table).word_logs(words)
    monkeypatch.setattr(language, "AT_ONCE", 7)
    assert np.allclose(whole, language.Model(pieces, ["x", "y"], table).word_logs(words), rtol=1e-12)


def test_language_learns_a_share_of_rows_without_ids(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(None, f"wort{i} haus baum", "de") for i in range(300)] + [(i, f"word{i} house tree", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = language.fit
    try:
        language.fit = lambda pieces, words, *rest: seen.append(words) or fit(pieces, words, *rest)
        language.train(docs, path, sample=30)
    finally:
        language.fit = fit
    learnt = {lang: sum(1 for x in seen[0] if x[0] == lang and x[1][:3] == "wor" and x[1][-1].isdigit()) for lang in ("de", "en")}
    assert 10 < learnt["de"] < 60 and 10 < learnt["en"] < 60


def test_orc_encoder_with_a_small_cache():
    """Words in and out of the cache, long ones, and a text with more words than both generations hold."""
    name = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(name), orc_ids.Encoder(open(name, encoding="utf-8").read(), 2, cached=50)
    rng = random.Random(8)
    letters = ["a", "Be", "ing", "É", "ß", "İ", "x1", ".", ",", "’", "中", "-", ":"]
    for _ in range(60):
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 150))] + ["Q" * 90, ".", "a,", "é;"]
        texts = [" ".join(words), "\t".join(words[::-1]), ""]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
        assert got == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert len(encoder.cache) < 50 and all(len(w) <= orc_ids.LONGEST for w in encoder.cache)


def test_byte_bpe_of_letters_and_marks():
    """Words whose longest matches do not fit, with and without marks, against the library; and another pattern."""
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {t: i for i, t in enumerate(tokens)}
    rng = random.Random(4)
    for pattern in (public_tokenizers.PATTERN, r"\p{L}{1,3}|[^\p{L}]"):
        codec = byte_bpe.Codec(tokens, byte_bpe.halves(tokens), pattern, words=30)
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for _ in range(600):
            words = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 16))) + rng.choice(["", ".", ",", "?!", "'s", "..", "é"]) for _ in range(6)]
            text = rng.choice([" ", "  ", "\n"]).join(words) + "h" * rng.randrange(0, 90)
            assert np.frombuffer(codec.encode(text.encode()), "<u4").tolist() == library.encode_ordinary(text)


def test_byte_bpe_of_many_texts():
    """Texts encoded together, with words met before, accents, marks, other scripts, far spaces and long words, against the library."""
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = byte_bpe.Codec(tokens, byte_bpe.halves(tokens), public_tokenizers.PATTERN, words=300)
    rng = random.Random(21)
    ends = ["", ".", ",", "###", "'", "'s", "'re.", "\u00d7", "\u00b2", "7", "_", "\u0301", "\u65e5\u672c", "\ufb01", "\u024f", "\u0250"]
    letters = "abcdehinorst\u00e9\u00f1\u00fc\u00df\u0142"
    for _ in range(40):
        texts = []
        for _ in range(rng.randrange(0, 12)):
            words = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) + rng.choice(ends) for _ in range(rng.randrange(0, 30))]
            texts.append(rng.choice([" ", " ", "  ", "\n", "\t ", "\u00a0"]).join(words) + rng.choice(["", "\n\n", " " + "ho" * 70]))
        got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all([t.encode() for t in texts])]
        assert got == [library.encode_ordinary(t) for t in texts]
        assert len(codec.known) < 600 and not any(len(w) > byte_bpe.LONGEST for w in codec.known)


def test_blocks_by_shingles_lose_no_link(spark, monkeypatch):
    """Near copies of long texts in many blocks have the links that brute force gives."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(24):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 250)
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    want = [sum(1 for j, b in enumerate(sets) if j != i and 5 * len(a & b) >= 4 * len(a | b)) for i, a in enumerate(sets)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_links for r in got.orderBy("doc_id").collect()] == want


def hot_classes(spark, n, hot, seed):
    """Classes that have ``hot`` places in common and no other two values."""
    places = np.random.default_rng(seed).permutation(n * jaccard_join.SIZE).reshape(n, -1).astype(np.uint32) + np.uint32(1 << 20)
    places[:, :hot] = np.arange(hot)
    return spark.createDataFrame([(hashlib.md5(b"%d" % i).digest(), bytearray(row.tobytes())) for i, row in enumerate(places)], "digest binary, places binary")


def test_paths_draw_no_place_twice(spark, monkeypatch):
    """Behind a place that 8 of 800 classes have in common all others differ, however many runs there are."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 3)
    found, _ = jaccard_join._met(hot_classes(spark, 8, 1, 2), 800, 0.8, range(15000))
    assert sum(edges.count() for edges in found) == 0


def test_minimum_hashes_of_unlike_sets_differ():
    """Equal values by chance grow with the square of the classes: of 8,000,000 pairs in 64 places hardly one may be."""
    rng = np.random.default_rng(3)
    places = jaccard_join.embedded([rng.integers(0, 1 << 62, 500, dtype=np.uint64) for _ in range(4000)])
    assert sum(len(column) - len(np.unique(column)) for column in places.T) <= 3


def test_rounds_of_blocks_lose_no_link_and_leave_no_tables(spark, monkeypatch):
    """Blocks of one cluster meet in several rounds; what was written on the way goes as soon as it is read."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(25)]
    wide, write = [], jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "ROUND_SHINGLES", 1)
    monkeypatch.setattr(jaccard_join, "cut", lambda df, name: wide.append((name, made := write(df, name), made.count())) or made)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = shingle_sets(rows)
    assert sorted((r.doc_id, r.group_id, r.n_links) for r in found) == [(i, 0, sum(b != i and 5 * len(sets[i] & sets[b]) >= 4 * len(sets[i] | sets[b]) for b in sets)) for i in range(25)]
    rounds = [n for name, _, n in wide if name == "compared"]
    assert len(rounds) > 1 and max(rounds) <= 3 * len(rows)
    there = {name for name, made, _ in wide if spark._jvm.java.io.File(made.inputFiles()[0].removeprefix("file:")).exists()}
    assert there <= {"signatures", "classes", "edges", "compared"}


def test_bands_of_sizes_lose_no_link(spark, monkeypatch):
    """A chain of texts of all lengths is one cluster; sets of unlike sizes do not meet, and the links are those of brute force."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    words, made, write = [f"w{i}" for i in range(200)], [], jaccard_join.cut
    rows = [(i, " ".join(words[: 8 + i * 4])) for i in range(48)]
    monkeypatch.setattr(jaccard_join, "cut", lambda df, name: made.append((name, out := write(df, name), out.count())) or out)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = shingle_sets(rows)
    assert sorted((r.doc_id, r.n_links) for r in found) == [(i, sum(b != i and 5 * len(sets[i] & sets[b]) >= 4 * len(sets[i] | sets[b]) for b in sets)) for i in sets]
    compared = sum(n for name, _, n in made if name == "compared")
    assert 0 < compared < 48 * 12 * 0.75  # without bands each of 48 sets meets 12 blocks
