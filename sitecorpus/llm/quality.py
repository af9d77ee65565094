"""Quality rules with a trained verdict.

Fixed rules come first: too few words, or too many of them in repeated passages.
What passes them is judged by a logistic regression over hashed word and character
n-grams, fitted on labelled rows.  Each family of n-grams (words, word pairs, three and
four characters) gives the mean of its weights over all its occurrences in the whole
text, so a text's score is a sum of table look-ups.  A part of the labelled rows is
held back from the fit and serves to calibrate the scores to probabilities
(a slope and a shift); a text is kept from ``THRESHOLD`` on.

The fit takes at most ``LABELLED`` labelled rows, those whose hashed ids are smallest.
Scoring runs in Arrow batches on the executors.  Without labelled rows of both kinds
only the fixed rules decide.

Defined cases: NULL or empty texts have no words and fail; labels that are NULL, that name
no document or whose document has no words are left out; repeated documents are each
scored, repeated labels each count; texts are read whole; the output column replaces one
of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from sitecorpus.llm.common import as_bytes, drop_kept, groups, mix, release, releasing, ship, span_hashes

#: Labelled rows that the fit takes at most, and every how many of them calibrates.
LABELLED = 4000
HELD = 4
#: Buckets of each family of n-grams.
BITS = 16
FAMILIES = 4
#: Rounds of the fit, its step, the weight of its penalty.
ROUNDS = 120
STEP = 0.3
PENALTY = 1e-5
#: Entries of the sparse rows that the fit handles at once.
ENTRIES = 1 << 20
#: Bytes of text whose words and characters are arrays at once, some hundred bytes for each.
SLICE_BYTES = 1 << 18
#: Least words; most repeated words of a hundred; least probability.
LEAST_WORDS = 50
MOST_REPEATED = 50
THRESHOLD = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = np.frombuffer("#*$%&|<>".encode("utf-32-le"), np.uint32)
BLANKS = " \t\n\x0b\x0c\r"
RESULT = StructType([StructField(c, LongType(), False) for c in COUNTS] + [StructField("probability", DoubleType()), StructField("base_failed", BooleanType(), False), StructField("kept", BooleanType(), False)])


class Texts:
    """The words and characters of some texts as arrays; ``more`` tells that another text of the group follows."""

    def __init__(self, texts: list[str], more: bool = False):
        self.n = len(texts)
        self.codes = np.frombuffer(("\n".join(texts) + "\n" * more).encode("utf-32-le"), np.uint32)
        self.first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        inside = np.zeros(len(self.codes) + 2, np.int8)
        inside[1:-1] = (self.codes != 32) & ((self.codes < 9) | (self.codes > 13))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.of = np.searchsorted(self.first, self.starts, "right") - 1
        self.values = mix(self.codes.astype(np.uint64) + np.uint64(0x51ED))
        self.words = span_hashes(self.values, self.starts, self.ends)
        self.texts = texts

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of every ``k`` words that follow each other in one text."""
        n = max(0, len(self.words) - k + 1)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = mix(out + self.words[i : n + i] + np.uint64(i + 1))
        places = np.flatnonzero(self.of[:n] == self.of[k - 1 : n + k - 1])
        return places, out[places]

    def counts(self) -> dict[str, np.ndarray]:
        n_words = np.bincount(self.of, minlength=self.n)
        places, runs = self.runs(3)
        keys = mix(runs + self.of[places].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(self.words), bool)
        for i in range(3):
            hit[places[twice] + i] = True
        symbols = np.searchsorted(self.first, np.flatnonzero(np.isin(self.codes, SYMBOLS)), "right") - 1
        return {
            "n_words": n_words,
            "word_chars": np.bincount(self.of, self.ends - self.starts, self.n).astype(np.int64),
            "n_symbols": np.bincount(symbols, minlength=self.n),
            "n_dup_lines": np.array([repeated_lines(t) for t in self.texts], np.int64),
            "n_repeat_words": np.bincount(self.of, hit, self.n).astype(np.int64),
        }

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each family the text and the bucket of every occurrence."""
        shift = np.uint64(64 - BITS)
        out = [(self.of, (self.words >> shift).astype(np.int64))]
        places, pairs = self.runs(2)
        out.append((self.of[places], (pairs >> shift).astype(np.int64)))
        owner = np.repeat(np.arange(self.n), np.diff(np.append(self.first, len(self.codes) + 1)))[: len(self.codes)]
        for k in (3, 4):
            n = max(0, len(self.values) - k + 1)
            sums = np.zeros(n, np.uint64)
            for i in range(k):
                sums = sums * np.uint64(0x9E3779B97F4A7C15) + self.values[i : n + i]
            inside = owner[:n] == owner[k - 1 : n + k - 1]
            out.append((owner[:n][inside], ((sums * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)[inside]))
        return out


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def linear(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """Each text's sum over families of its mean weight."""
    total = np.zeros(texts.n)
    for family, (of, buckets) in enumerate(texts.features()):
        n = np.bincount(of, minlength=texts.n)
        total += np.bincount(of, weights[family][buckets], texts.n) / np.maximum(n, 1)
    return total


class Model:
    """Weights, shift and calibration."""

    def __init__(self, weights: np.ndarray, shift: float, slope: float, at: float):
        self.weights, self.shift, self.slope, self.at = weights, shift, slope, at

    def probabilities(self, texts: Texts) -> np.ndarray:
        return sigmoid(self.slope * (linear(texts, self.weights) + self.shift) + self.at)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: np.ndarray, buckets: np.ndarray, shares: np.ndarray, labels: np.ndarray) -> Model | None:
    """A model from sparse rows: entry ``i`` gives row ``rows[i]`` the share ``shares[i]`` of ``buckets[i]``."""
    held = np.arange(len(labels)) % HELD == HELD - 1
    if min(np.bincount(labels[~held], minlength=2)) == 0:
        return None
    size = FAMILIES << BITS
    weights, shift = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    fits = ~held
    balance = np.where(labels == 1, 0.5 / max(1, (labels[fits] == 1).sum()), 0.5 / max(1, (labels[fits] == 0).sum())) * fits
    # Some entries at a time, so that what a round makes stays small beside the entries.
    parts = [(rows[a : a + ENTRIES], buckets[a : a + ENTRIES], shares[a : a + ENTRIES]) for a in range(0, len(rows), ENTRIES)]

    def scored() -> np.ndarray:
        return sum((np.bincount(r, weights[b] * s, len(labels)) for r, b, s in parts), np.full(len(labels), shift))

    for t in range(1, ROUNDS + 1):
        errors = (sigmoid(scored()) - labels) * balance
        slopes = sum((np.bincount(b, errors[r] * s, size) for r, b, s in parts), PENALTY * weights)
        gradient = np.append(slopes, errors.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        step = STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-7)
        weights -= step[:-1]
        shift -= step[-1]
    slope, at = calibrated(scored()[held], labels[held])
    return Model(weights.reshape(FAMILIES, -1).astype(np.float32), shift, slope, at)


def calibrated(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift under which the held scores are probabilities (Newton's method, targets drawn in a little)."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, p = np.stack([scores, np.ones_like(scores)]), np.array([1.0, 0.0])
    for _ in range(50):
        y = sigmoid(p @ x)
        hessian = (x * (y * (1 - y))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (y - target))
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def _strings(column: pa.Array) -> list[str]:
    return [t.decode() for t in as_bytes(column)]


def _slices(column: pa.Array):
    texts = as_bytes(column)
    for a, b in groups(texts):
        some = texts[a:b]
        for c, d in groups(some, SLICE_BYTES):
            yield Texts([t.decode() for t in some[c:d]], d < b - a)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED) -> Model | None:
    """A model from at most ``labelled`` labelled rows; None where they are all of one kind."""
    ship(docs.sparkSession)
    some = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("__id"), F.col(label).cast("long").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id", "label")
        .limit(labelled)
    )
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))

    def vectors(batches):
        drop_kept()
        for batch in batches:
            labels, at = batch.column(1).to_pylist(), 0
            for texts in _slices(batch.column(2)):
                found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * texts.n
                parts = []
                for family, (of, buckets) in enumerate(texts.features()):
                    keys, n = np.unique((of << np.int64(BITS)) | buckets, return_counts=True)
                    owner = keys >> BITS
                    parts.append((owner, (keys & ((1 << BITS) - 1)) + (family << BITS), n / np.bincount(of, minlength=texts.n)[owner]))
                owner, buckets, shares = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[order], np.arange(texts.n + 1))
                found = [(buckets[order[a:b]], shares[order[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(batch.column(0).to_pylist()[at : at + texts.n], pa.string()),
                        "label": pa.array(labels[at : at + texts.n], pa.int64()),
                        "buckets": pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()),
                        "shares": pa.array([s.astype("<f4").tobytes() for _, s in found], pa.binary()),
                    }
                )
                at += texts.n
            release()

    rows = texts.join(some, "__id").select(F.col("__id").cast("string"), "label", "text").mapInArrow(vectors, "id string, label long, buckets binary, shares binary")
    found = sorted(rows.where(F.length("buckets") > 0).toArrow().to_pylist(), key=lambda r: (hash_of(r["id"]), r["id"], r["label"]))
    if not found:
        return None
    label_of = np.array([r["label"] for r in found])
    owners = np.repeat(np.arange(len(found), dtype=np.int32), [len(r["buckets"]) // 4 for r in found])
    buckets, shares = (np.frombuffer(b"".join([r.pop(c) for r in found]), kind) for c, kind in (("buckets", "<i4"), ("shares", "<f4")))
    return fit(owners, buckets, shares, label_of)


def hash_of(text: str) -> int:
    """A fixed order without a meaning, for folds."""
    import zlib

    return zlib.crc32(text.encode())


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "quality_rules") -> DataFrame:
    """Add ``out``: the counts, the probability (NULL without a model), ``base_failed`` and ``kept``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(column: pa.Array) -> pa.Array:
        drop_kept()
        parts = [_scored(t, shared.value) for t in _slices(column)]
        columns = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(len(COUNTS) + 3)]
        kinds = [pa.int64()] * len(COUNTS) + [pa.float64(), pa.bool_(), pa.bool_()]
        arrays = [pa.array(c, k, from_pandas=True) for c, k in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, fields=[pa.field(f.name, k, f.nullable) for f, k in zip(RESULT.fields, kinds, strict=True)])

    return docs.withColumn(out, F.arrow_udf(releasing(scored), RESULT)(F.col(text)))


def _scored(texts: Texts, model: Model | None) -> list[np.ndarray]:
    counts = texts.counts()
    failed = base_failed(counts["n_words"], counts["n_repeat_words"])
    chance = model.probabilities(texts) if model is not None else np.full(texts.n, np.nan)
    kept = ~failed & ((chance >= THRESHOLD) | np.isnan(chance))
    return [*(counts[c] for c in COUNTS), chance, failed, kept]


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "quality_rules") -> DataFrame:
    """Train on the labelled documents and score all."""
    return score(docs, train(docs, labels, doc_id, text), text, out)
