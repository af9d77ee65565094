"""Scores of whole documents by a gated recurrent language model.

Words run from white space to white space, A-Z in lower case, and every document closes
with an end token.  All training tokens are counted.  Tokens are known by 64-bit hashes.

The model: a gated recurrent network in numpy reads the tokens one by one and predicts
the next in two steps, its class, then the token within the class.  Tokens seen ``LEAST`` times
or more have trained vectors of their own as input and as member of a class with a softmax over its
members; the number of classes and of members in each follows their number (``HEAD_CLASSES`` at least, ``MOST_CLASSES``
at most, beyond which the most frequent are taken).  All
others fall into ``TAIL_CLASSES`` classes by their spelling (last two letters); in these a token has the
share of its count plus one, and what was never seen together one more, so the probabilities of
all tokens sum to one.

The fit is truncated backpropagation over windows of ``WINDOW`` tokens; the state goes on
from window to window and starts anew with each document.  The fit is one pass over all training
documents, cut into ``ROUNDS`` by a hash of id and text: in each round every task fits a copy on its documents of
that round (small partitions share a task, one for ``COPY_TOKENS`` at most), and the copies are averaged in a tree.  Scoring carries the state through the whole document.

Counts meet documents in two tiers: the most frequent tokens, at most ``FREQUENT`` by a
histogram of the counts, go to all tasks; the rest of a document's tokens, whose counts
are small, meet them in a join on the hash, where no key is hot.

Defined cases: a NULL or empty text is its end token; documents with a NULL id learn; rows
that repeat in full each count and are each returned; texts are scored whole; with
nothing to learn from all tokens are unseen; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.llm.common import SPACED, as_bytes, groups, mix, ship

#: Classes of frequent tokens, and members of each: at least, and at most (9 MB of parameters). How often these are seen.
HEAD_CLASSES = 24
HEAD = HEAD_CLASSES * HEAD_CLASSES
MOST_CLASSES = 192
LEAST = 16
TAIL_CLASSES = 64
#: Tokens of the table that goes to all tasks.
FREQUENT = 1_000_000
#: Units of the state; steps of a window; sequences fitted side by side, and how many times that on long inputs; rounds that together read every document once.
UNITS = 24
WINDOW = 20
STREAMS = 128
MOST_STREAMS = 4
ROUNDS = 3
STEP = 0.02
#: Training tokens (about 16 MB of text) for each copy that is fitted in a round, so that the copies sent follow the input and not the number of tasks.
COPY_TOKENS = 2_500_000
#: Documents scored side by side; states that meet the softmax together.
ABREAST = 1024
TOGETHER = 1 << 14
END = int(mix(np.array([1], np.uint64)).view(np.int64)[0])

_MARK = np.array([chr(b) in ".,;:!?\"')(" for b in range(256)])


def tails(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each word by its spelling."""
    array = np.frombuffer(data, np.uint8)
    last = ends - 1
    for _ in range(2):
        last = last - (_MARK[array[last]] & (last > starts))
    before = np.maximum(last - 1, starts)
    key = SPACED.fold[array[last]].astype(np.uint64) * np.uint64(257) + SPACED.fold[array[before]]
    return (mix(key) % np.uint64(TAIL_CLASSES)).astype(np.int64)


def tokens(texts: list[bytes]):
    """Text number, hash and spelling class of every word, text by text."""
    data, of, starts, ends, hashes = SPACED.of_texts(texts)
    return of, hashes.view(np.int64), tails(data, starts, ends) if len(starts) else np.empty(0, np.int64)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``hash, n, tail`` of every token."""

    def counted(batches):
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in groups(texts, 8 << 20):
                _, hashes, tail = tokens(texts[a:b])
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": np.append(found, END), "n": np.append(n, b - a), "tail": np.append(tail[first], 0).astype(np.int32)})

    return docs.select(text).mapInArrow(counted, "hash long, n long, tail int").groupBy("hash").agg(F.sum("n").alias("n"), F.min("tail").alias("tail"))


class Vocabulary:
    """Totals, the frequent tokens and the classes."""

    def __init__(self, table: DataFrame):
        bands = table.groupBy(F.floor(F.log2("n")).alias("band")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).orderBy(F.desc("band")).collect()
        self.total = sum(r["n"] for r in bands)
        self.types = sum(r["types"] for r in bands)
        least, held = None, 0
        for r in bands:
            held += r["types"]
            if held > FREQUENT:
                break
            least = 1 << r["band"]
        some = (table.where(F.col("n") >= least) if least else table.limit(0)).toArrow()
        hashes, n, tail = (some.column(c).to_numpy().astype(np.int64) for c in ("hash", "n", "tail"))
        order = np.argsort(hashes)
        self.hashes, self.n, tail = hashes[order], n[order], tail[order]
        side = min(MOST_CLASSES, max(HEAD_CLASSES, math.isqrt(max(0, int((self.n >= LEAST).sum()) - 1)) + 1))
        self.size = side * side
        ranked = np.lexsort((self.hashes, -self.n, self.hashes != END))[: self.size]
        self.ids = self.size + tail
        self.ids[ranked] = np.arange(len(ranked))
        self.tail_sums = np.zeros(TAIL_CLASSES)
        for r in table.groupBy("tail").agg(F.sum(F.col("n") + 1).alias("n")).collect():
            self.tail_sums[r["tail"]] = r["n"]
        self.tail_sums -= np.bincount(tail[ranked], self.n[ranked] + 1, TAIL_CLASSES)
        self.head_n = np.zeros(self.size)
        self.head_n[: len(ranked)] = self.n[ranked]

    def look_up(self, hashes: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input id and count of each token; count 0 where it is not frequent."""
        if not len(self.hashes):
            return np.where(hashes == END, 0, self.size + tail), np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes
        ids = np.where(known, self.ids[at], np.where(hashes == END, 0, self.size + tail))
        return ids, np.where(known, self.n[at], 0)

    def sequence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, counts and hashes of all tokens with the ends, and the number of tokens of each text."""
        of, hashes, tail = tokens(texts)
        sizes = np.bincount(of, minlength=len(texts))
        at = np.cumsum(sizes)
        hashes, tail = np.insert(hashes, at, END), np.insert(tail, at, 0)
        ids, n = self.look_up(hashes, tail)
        return ids, n, hashes, sizes + 1


def _classes(ids: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and place in it."""
    return np.where(ids < side * side, ids // side, ids - side * side + side), ids % side


def start(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters before the fit: the counts alone decide."""
    random = np.random.default_rng(7)
    side = math.isqrt(len(vocabulary.head_n))
    heads = vocabulary.head_n.reshape(side, side)
    classes = np.append(heads.sum(axis=1), vocabulary.tail_sums) + 0.5
    made = {
        "inputs": random.normal(0, 1, (side * side + TAIL_CLASSES, UNITS)),
        "taken": random.normal(0, 0.3 * UNITS**-0.5, (UNITS, 3 * UNITS)),
        "state": random.normal(0, UNITS**-0.5, (UNITS, 3 * UNITS)),
        "bias": np.zeros(3 * UNITS),
        "classes": random.normal(0, 0.05, (UNITS, side + TAIL_CLASSES)),
        "class_bias": np.log(classes / classes.sum()),
        "members": random.normal(0, 0.05, (side, side, UNITS)),
        "member_bias": np.where(heads > 0, np.log(np.maximum(heads, 1) / np.maximum(heads.sum(axis=1, keepdims=True), 1)), -40.0),
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _step(p: dict, ids: np.ndarray, state: np.ndarray):
    """One step of the network; also what the backward pass needs."""
    given, own = p["inputs"][ids] @ p["taken"] + p["bias"], state @ p["state"]
    gates = _sigmoid(given[:, : 2 * UNITS] + own[:, : 2 * UNITS])
    keep, reset = gates[:, :UNITS], gates[:, UNITS:]
    new = np.tanh(given[:, 2 * UNITS :] + reset * own[:, 2 * UNITS :])
    return new + keep * (state - new), keep, reset, new, own[:, 2 * UNITS :]


def _picked(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of the softmax at one place of every row; ``x`` becomes the exponentials, whose sums follow."""
    x -= x.max(axis=1, keepdims=True)
    found = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    sums = x.sum(axis=1)
    return found - np.log(sums), sums


def _by_class(wanted: np.ndarray, side: int):
    """The rows of each class of frequent tokens that has any."""
    order = np.argsort(wanted, kind="stable")
    bounds = np.searchsorted(wanted[order], np.arange(side + 1))
    for c in np.flatnonzero(np.diff(bounds)).tolist():
        yield c, order[bounds[c] : bounds[c + 1]]


def _gradients(p: dict, before: np.ndarray, targets: np.ndarray, state: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """As ``gradients``; that of ``inputs`` as the rows that were read, and their values."""
    streams, steps = targets.shape
    side = p["members"].shape[0]
    kept, states, inner = [], [], []
    for t in range(steps):
        keep_state = (before[:, t] != 0).astype(np.float32)[:, None]
        old = state * keep_state
        state, keep, reset, new, own = _step(p, before[:, t], old)
        kept.append(keep_state)
        inner.append((old, keep, reset, new, own))
        states.append(state)
    flat = np.concatenate(states)
    wanted, place = _classes(targets.T.ravel(), side)
    error = flat @ p["classes"] + p["class_bias"]
    logs, sums = _picked(error, wanted)
    loss = -logs.sum()
    error /= sums[:, None]
    error[np.arange(len(wanted)), wanted] -= 1
    g = {"classes": flat.T @ error, "class_bias": error.sum(axis=0), "members": np.zeros_like(p["members"]), "member_bias": np.zeros_like(p["member_bias"])}
    back = error @ p["classes"].T
    for c, some in _by_class(wanted, side):
        own, at = flat[some], place[some]
        wrong = own @ p["members"][c].T + p["member_bias"][c]
        logs, sums = _picked(wrong, at)
        loss -= logs.sum()
        wrong /= sums[:, None]
        wrong[np.arange(len(some)), at] -= 1
        g["members"][c] = wrong.T @ own
        g["member_bias"][c] = wrong.sum(axis=0)
        back[some] += wrong @ p["members"][c]
    back = back.reshape(steps, streams, UNITS)
    g["state"] = np.zeros_like(p["state"])
    given = np.empty((steps, streams, 3 * UNITS), p["state"].dtype)
    later = np.zeros((streams, UNITS), np.float32)
    for t in range(steps - 1, -1, -1):
        old, keep, reset, new, own = inner[t]
        d = back[t] + later
        d_keep = d * (old - new) * keep * (1 - keep)
        d_new = d * (1 - keep) * (1 - new * new)
        d_reset = d_new * own * reset * (1 - reset)
        given[t] = np.concatenate([d_keep, d_reset, d_new], axis=1)
        through = np.concatenate([d_keep, d_reset, d_new * reset], axis=1)
        g["state"] += old.T @ through
        later = (d * keep + through @ p["state"].T) * kept[t]
    given = given.reshape(-1, 3 * UNITS)
    read = before.T.ravel()
    g["bias"] = given.sum(axis=0)
    g["taken"] = p["inputs"][read].T @ given
    order = np.argsort(read, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(read[order]) != 0))
    g["inputs"] = read[order[first]], np.add.reduceat((given @ p["taken"].T)[order], first)
    return float(loss), g, state


def gradients(p: dict, before: np.ndarray, targets: np.ndarray, state: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Loss and gradients of one window (rows: streams), and the state after it.

    ``before`` holds the token before each target; after an end token the state is new.
    """
    loss, g, state = _gradients(p, before, targets, state)
    rows, values = g["inputs"]
    g["inputs"] = np.zeros_like(p["inputs"])
    g["inputs"][rows] = values
    return loss, g, state


class Adam:
    """Steps along the gradients' running means."""

    def __init__(self, p: dict):
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, p: dict, g: dict, scale: float, size: float) -> None:
        """One step by ``scale`` times the gradients; rows of ``inputs`` that were not read stay."""
        self.t += 1
        for k in p:
            rows, d = g[k] if k == "inputs" else (slice(None), g[k])
            d = d * np.float32(scale)
            first, second = self.first[k][rows] * np.float32(0.9) + d * np.float32(0.1), self.second[k][rows] * np.float32(0.99) + d * d * np.float32(0.01)
            self.first[k][rows], self.second[k][rows] = first, second
            np.sqrt(second, out=second)
            second *= np.float32((1 - 0.99**self.t) ** -0.5)
            second += np.float32(1e-6)
            first /= second
            first *= np.float32(size / (1 - 0.9**self.t))
            p[k][rows] -= first


def fit(p: dict, parts, size: float = STEP) -> int:
    """Fit ``p`` in place on sequences of ids; returns how many tokens were read."""
    adam, state, read = Adam(p), None, 0
    for ids in parts:
        streams = STREAMS * min(MOST_STREAMS, max(1, len(ids) // (STREAMS * 20 * WINDOW)))
        length = -(-len(ids) // streams)
        full = np.zeros(length * streams, np.int64)
        full[: len(ids)] = ids
        targets = full.reshape(streams, length)
        before = np.concatenate([[0], full[:-1]]).reshape(streams, length)
        state = np.zeros((streams, UNITS), np.float32)
        for t in range(0, length, WINDOW):
            _, g, state = _gradients(p, before[:, t : t + WINDOW], targets[:, t : t + WINDOW], state)
            adam.step(p, g, 1 / (streams * min(WINDOW, length - t)), size)
        read += len(ids)
    return read


def train(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[dict, int]:
    """Parameters after rounds of fits in all tasks, each averaged by tokens read; and how many tokens were read."""
    spark = docs.sparkSession
    p = start(vocabulary)
    words = spark.sparkContext.broadcast(vocabulary)
    done = 0
    copies = max(1, -(-vocabulary.total // COPY_TOKENS))
    for r in range(rounds):
        now = spark.sparkContext.broadcast(p)
        size = STEP / (r + 1)

        def fitted(batches, now=now, size=size):
            own = {k: v.copy() for k, v in now.value.items()}

            def parts():
                for batch in batches:
                    texts = as_bytes(batch.column(0))
                    for a, b in groups(texts, 4 << 20):
                        yield words.value.sequence(texts[a:b])[0]

            read = fit(own, parts(), size)
            if read:
                yield pa.RecordBatch.from_pydict({"fitted": pa.array([pickle.dumps((read, {k: v * np.float32(read) for k, v in own.items()}))], pa.binary())})

        def joined(a, b):
            return b if a is None else a if b is None else (a[0] + b[0], {k: a[1][k] + b[1][k] for k in a[1]})

        some = docs.where(F.pmod(F.xxhash64(doc_id, text), F.lit(rounds)) == r).select(text).coalesce(int(copies))
        rows = some.mapInArrow(fitted, "fitted binary").rdd.map(lambda row: pickle.loads(row[0]))
        total = rows.treeAggregate(None, joined, joined, depth=3)
        if total is not None:
            p = {k: (v / total[0]).astype(np.float32) for k, v in total[1].items()}
            done += total[0]
    return p, done


def _logs(p: dict, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each state the log of its token's class and, in the head, of the token in its class."""
    side = p["members"].shape[0]
    wanted, place = _classes(ids, side)
    found = _picked(states @ p["classes"] + p["class_bias"], wanted)[0]
    for c, some in _by_class(wanted, side):
        found[some] += _picked(states[some] @ p["members"][c].T + p["member_bias"][c], place[some])[0]
    return found


def log_likelihoods(p: dict, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the sum of the logs of its tokens' classes and, in the head, of the tokens in their classes."""
    out = np.zeros(len(sizes))
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    for k in range(0, len(order), ABREAST):
        some = order[k : k + ABREAST]
        left, at = sizes[some], first[some]
        state = np.zeros((len(some), UNITS), np.float32)
        before = np.zeros(len(some), np.int64)
        active = len(some)
        ends = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right")
        states, of, held = [], [], 0
        for t in range(int(left[0])):
            if ends[t] < active:
                active = int(ends[t])
                state, before = state[:active], before[:active]
            state = _step(p, before, state)[0]
            before = ids[at[:active] + t]
            states.append((state, before))
            of.append(some[:active])
            held += active
            if held >= TOGETHER or t + 1 == int(left[0]):
                logs = _logs(p, np.concatenate([x for x, _ in states]), np.concatenate([x for _, x in states]))
                out += np.bincount(np.concatenate(of), logs, len(out))
                states, of, held = [], [], 0
    return out


ROWS = "key long, doc_id {kind}, hash long, n long, n_tokens long, n_known long, counted double, modelled double"


def _scored(words, model, batches):
    log10 = np.log10
    for batch in batches:
        texts = as_bytes(batch.column(2))
        for a, b in groups(texts, 16 << 20):
            vocabulary: Vocabulary = words.value
            ids, n, hashes, sizes = vocabulary.sequence(texts[a:b])
            of = np.repeat(np.arange(b - a), sizes)
            known = n > 0
            counted = np.bincount(of, np.where(known, log10(n + 1.0), 0), b - a)
            tail = ids >= vocabulary.size
            fixed = np.zeros(len(ids))
            fixed[tail] = -log10(vocabulary.tail_sums[ids[tail] - vocabulary.size] + 1)
            fixed[tail & known] += log10(n[tail & known] + 1.0)
            modelled = np.bincount(of, fixed, b - a) + log_likelihoods(model.value, ids, sizes) / np.log(10)
            keys = batch.column(0).to_numpy()[a:b]
            rare = np.flatnonzero(~known)
            nothing = np.zeros(b - a, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column(1).slice(a, b - a), pa.array(keys), pa.array(nothing), pa.array(sizes), pa.array(np.bincount(of, known, b - a).astype(np.int64)), pa.array(counted), pa.array(modelled)],
                ["key", "doc_id", "hash", "n", "n_tokens", "n_known", "counted", "modelled"],
            )
            if len(rare):
                order = np.lexsort((hashes[rare], of[rare]))
                o, h = of[rare][order], hashes[rare][order]
                new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
                times = np.diff(np.append(new, len(o)))
                for s in range(0, len(new), 1 << 18):
                    some = new[s : s + (1 << 18)]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[o[some]]), pa.nulls(m, batch.column(1).type), pa.array(h[some]), pa.array(times[s : s + m]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())],
                        ["key", "doc_id", "hash", "n", "n_tokens", "n_known", "counted", "modelled"],
                    )


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row, learning from those not ``held_out``."""
    spark = docs.sparkSession
    ship(spark)
    learnt = docs.where(~F.coalesce(held_out, F.lit(False)))
    table = cut(counts(learnt, text), "counts")
    vocabulary = Vocabulary(table)
    model = spark.sparkContext.broadcast(train(learnt, vocabulary, doc_id, text)[0])
    words = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = rows.mapInArrow(lambda batches: _scored(words, model, batches), ROWS.format(kind=kind))
    seen = table.select("hash", F.col("n").alias("seen"))
    met = parts.join(seen, "hash", "left").withColumn("seen", F.when(F.col("n") > 0, F.col("seen")))
    rare = F.col("n") * F.log10(F.col("seen") + 1)
    sums = met.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.count("n_tokens").alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_known").alias("n_known"),
        F.max("counted").alias("counted"),
        F.max("modelled").alias("modelled"),
        F.sum(F.when(F.col("seen").isNotNull(), F.col("n"))).alias("rare_known"),
        F.sum(rare).alias("rare"),
    )
    found = sums.withColumn("rare", F.coalesce("rare", F.lit(0.0)) / F.col("copies")).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    floor = float(np.log10(vocabulary.total + vocabulary.types + 1))
    return found.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("rare_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("counted") + F.col("rare") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("modelled") + F.col("rare")).alias("score"),
    )
