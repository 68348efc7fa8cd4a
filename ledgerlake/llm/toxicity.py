"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of the word itself (words of the sample, others none) beside the scaled sum of the
embeddings of its byte n-grams. Overlapping windows of WINDOW words run through a GRU in either
direction; attention weighs the states of a window and a logistic unit scores their mean. A document's score is that of
its worst window. Labels are of documents, so learning alternates: pick the windows that most likely carry the
label of a toxic document, and those of clean documents that look worst, train, and pick again.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import learnable, learning_sample
from .shingles import give_back, slices, words

#: Words of a window, and between the beginnings of two: a passage of WINDOW - STRIDE words, here half a window, lies whole in one wherever it begins.
WINDOW, STRIDE = 32, 16
HIDDEN = 8
WORD_DIM = CHAR_DIM = 8
CHAR_BUCKETS = 1 << 17
#: Orders of the byte n-grams of a word, which has a mark at each end.
GRAMS = (3, 5, 7)
#: Bound of the sample: documents of each label that are learnt from.
LEARN_PER_LABEL = 700
MIN_DOCUMENTS = 3
ROUNDS, EPOCHS, BATCH = 3, 4, 128
THRESHOLD = 0.7
#: Windows that run through the network at a time.
BLOCK = 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # exp of a large number is inf, and the result 0
        x = np.exp(-x)
    x += 1
    return np.divide(1, x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    x = sigmoid(2 * x)
    x *= 2
    x -= 1
    return x


def grams_of(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of all words, the word of each, and how many a word has."""
    joined = np.frombuffer(b"^" + b"$^".join(distinct) + b"$", dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct)) + 2
    end = np.repeat(np.cumsum(sizes), sizes)
    word = np.repeat(np.arange(len(distinct)), sizes)
    code, at, last = np.zeros(len(end), np.uint32), np.arange(len(end)), 0
    found, owner = [], []
    for n in GRAMS:
        for k in range(last, n):
            code = code[: len(code) - (k > 0)] * np.uint32(0x01000193) ^ joined[k : k + len(code) - (k > 0)] if k else code ^ joined[: len(code)]
        inside = at[: len(code)] + n <= end[: len(code)]
        h = (code[inside] + np.uint32(n)) * np.uint32(0x9E3779B1)
        found.append(((h ^ (h >> np.uint32(15))) & np.uint32(CHAR_BUCKETS - 1)).astype(np.int64))
        owner.append(word[: len(code)][inside])
        last = n
    grams, owner = np.concatenate(found), np.concatenate(owner)
    return grams, owner, np.bincount(owner, minlength=len(distinct))


def windows(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in the joined words, length and document of each window; every word lies in one at least."""
    start, length, own = [], [], []
    at = 0
    for d, n in enumerate(sizes):
        s = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, dtype=np.int64)
        start.append(at + s)
        length.append(np.minimum(WINDOW, n - s))
        own.append(np.full(len(s), d))
        at += n
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (start, length, own))  # type: ignore[return-value]


@dataclass
class Network:
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    #: Buckets of n-grams that enough documents of the sample have; others count for nothing.
    known: np.ndarray = field(default_factory=lambda: np.ones(CHAR_BUCKETS, dtype=bool))
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], seed: int = 7, known: np.ndarray | None = None) -> Network:
        rnd = np.random.default_rng(seed)
        n = lambda *s, scale: (rnd.standard_normal(s) * scale).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"word": np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32), "char": np.zeros((CHAR_BUCKETS, CHAR_DIM), np.float32)}
        for way in "fb":
            p |= {f"W{way}": n(d, 3 * h, scale=d**-0.5), f"U{way}": n(h, 3 * h, scale=h**-0.5), f"b{way}": np.zeros(3 * h, np.float32)}
        p |= {"A": n(2 * h, 2 * h, scale=(2 * h) ** -0.5), "v": n(2 * h, scale=0.5), "o": n(2 * h, scale=0.5), "c": np.zeros(1, np.float32), "scale": np.ones(1, np.float32), "shift": np.zeros(1, np.float32)}
        return cls(vocabulary, np.ones(CHAR_BUCKETS, dtype=bool) if known is None else known, p)

    def inputs(self, distinct: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The input vector of each distinct word, and what its gradient needs."""
        ids = np.fromiter(map(self.vocabulary.get, distinct, itertools.repeat(0)), dtype=np.int64, count=len(distinct))
        grams, owner, sizes = grams_of(distinct)
        scale = np.maximum(sizes, 1).astype(np.float32) ** -0.5
        known = self.known[grams]
        grams, owner = grams[known], owner[known]
        table = self.p["char"]
        sums = np.stack([np.bincount(owner, weights=table[grams, j], minlength=len(distinct)) for j in range(CHAR_DIM)], axis=1).astype(table.dtype)
        return np.concatenate([self.p["word"][ids], sums * scale[:, None]], axis=1), (ids, grams, owner, scale)

    def _pass(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of a GRU over the words at[:, t]; x: input projections of the distinct words; 0 where mask is 0."""
        n, t_all, h = len(at), at.shape[1], HIDDEN
        u, out, kept = self.p[f"U{way}"], np.zeros((t_all, n, h), np.float32), []
        state = np.zeros((n, h), np.float32)
        full = mask.all(axis=0)
        for t in range(t_all) if way == "f" else reversed(range(t_all)):
            xt = x.take(at[:, t], axis=0)
            g = state @ u[:, : 2 * h]
            g += xt[:, : 2 * h]
            g = sigmoid(g)
            r, z = g[:, :h], g[:, h:]
            rs = r * state
            c = rs @ u[:, 2 * h :]
            c += xt[:, 2 * h :]
            c = tanh(c)
            new = c + z * (state - c)
            if not full[t]:
                new *= mask[:, t, None]
            if keep:
                kept.append((t, state, r, z, rs, c, mask[:, t, None]))
            state = out[t] = new
        return out, kept

    def forward(self, x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """The logit of each window; at: index into the distinct words' inputs x."""
        mask = (np.arange(at.shape[1]) < length[:, None]).astype(np.float32)
        runs = [self._pass(x @ self.p[f"W{w}"] + self.p[f"b{w}"], at, mask, w, keep) for w in "fb"]
        s = np.concatenate([r[0] for r in runs], axis=2)  # time, window, state
        a = tanh(s @ self.p["A"])
        e = np.exp(np.clip(a @ self.p["v"], -30, 30)) * mask.T
        e /= np.maximum(e.sum(axis=0), 1e-12)
        pooled = np.einsum("tn,tnh->nh", e, s)
        return pooled @ self.p["o"] + self.p["c"], (mask, runs, s, a, e, pooled)

    def gradients(self, distinct: list[bytes], at: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        x, (ids, grams, owner, scale) = self.inputs(distinct)
        logit, (mask, runs, s, a, e, pooled) = self.forward(x, at, length, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * p["o"]
        ds = e[:, :, None] * dpool
        de = (s * dpool).sum(axis=2)
        dscore = e * (de - (e * de).sum(axis=0))
        g["v"] = np.tensordot(dscore, a, axes=([0, 1], [0, 1]))
        dpre = dscore[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.tensordot(s, dpre, axes=([0, 1], [0, 1]))
        ds = ds + dpre @ p["A"].T
        dx = np.zeros_like(x)
        for way, (_, kept), part in zip("fb", runs, (slice(0, h), slice(h, 2 * h)), strict=True):
            u, carry = p[f"U{way}"], np.zeros((len(y), h), np.float32)
            dproj = np.zeros((len(x), 3 * h), np.float32)
            for t, prev, r, z, rs, c, m in reversed(kept):
                dn = (ds[t][:, part] + carry) * m
                dc = dn * (1 - z) * (1 - c * c)
                drs = dc @ u[:, 2 * h :].T
                dz = dn * (prev - c) * z * (1 - z)
                dr = drs * prev * r * (1 - r)
                dg = np.concatenate([dr, dz], axis=1)
                g[f"U{way}"][:, : 2 * h] += prev.T @ dg
                g[f"U{way}"][:, 2 * h :] += rs.T @ dc
                carry = dn * z + drs * r + dg @ u[:, : 2 * h].T
                np.add.at(dproj, at[:, t], np.concatenate([dg, dc], axis=1))
            g[f"W{way}"], g[f"b{way}"] = x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"W{way}"].T
        np.add.at(g["word"], ids, dx[:, :WORD_DIM])
        g["word"][0] = 0
        np.add.at(g["char"], grams, (dx[:, WORD_DIM:] * scale[:, None])[owner])
        return g

    def window_logits(self, distinct: list[bytes], at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of windows that index into a list of distinct words, a block at a time."""
        x, _ = self.inputs(distinct)
        return np.concatenate([self.forward(x, at[i : i + BLOCK], length[i : i + BLOCK])[0] for i in range(0, len(at), BLOCK)]) if len(at) else np.zeros(0, np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A score from 0 to 1 for each whole text: that of its worst window; 0 without a word."""
        return sigmoid(self.p["scale"] * self.document_logits([words(t) for t in texts]) + self.p["shift"]).astype(np.float64)

    def document_logits(self, split: list[list[bytes]]) -> np.ndarray:
        distinct, ids, (start, length, own) = indexed(split)
        best = np.full(len(split), -1e4, dtype=np.float32)
        np.maximum.at(best, own, self.window_logits(distinct, ids[start[:, None] + np.arange(WINDOW)], length))
        return best


def indexed(split: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, tuple]:
    """Distinct words, the joined words as indexes into them (with room for a window at the end), and the windows."""
    joined = list(itertools.chain.from_iterable(split))
    place = dict(zip(distinct := list(dict.fromkeys(joined)), range(len(distinct))))
    ids = np.fromiter(map(place.__getitem__, joined), dtype=np.int64, count=len(joined))
    return distinct, np.concatenate([ids, np.zeros(WINDOW, np.int64)]), windows([len(w) for w in split])


def _vocabulary(split: list[list[bytes]]) -> dict[bytes, int]:
    seen: dict[bytes, int] = {}
    for w in split:
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    return {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= MIN_DOCUMENTS))}


def _document_counts(split: list[list[bytes]], y: np.ndarray) -> np.ndarray:
    """In how many clean and toxic documents each bucket of n-grams occurs."""
    seen = np.zeros((2, CHAR_BUCKETS))
    for w, label in zip(split, y, strict=True):
        if w:
            seen[int(label), np.unique(grams_of(sorted(set(w)))[0])] += 1
    return seen


def _suspicion(seen: np.ndarray, y: np.ndarray, distinct: list[bytes], at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How much more often the most telling n-grams of a window's words occur in toxic documents than in clean ones."""
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    grams, owner, _ = grams_of(distinct)
    word = np.full(len(distinct), -9.0)
    np.maximum.at(word, owner, odds[grams])
    each = np.where(np.arange(WINDOW) < length[:, None], word[at], -9.0)
    return np.sort(each, axis=1)[:, -2:].sum(axis=1)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Fits a network to whole texts and their labels. Without both labels it gives every text a low score."""
    split, y = [words(t) for t in texts], np.array(labels, dtype=np.float32)
    seen = _document_counts(split, y)
    net = Network.fresh(_vocabulary(split), seed, seen.sum(axis=0) >= MIN_DOCUMENTS)
    if not len(y) or y.min() == y.max():
        net.p["shift"] -= 3 if not len(y) or y.max() == 0 else -3
        net.p["scale"] *= 0
        return net
    distinct, ids, (start, length, own) = indexed(split)
    at = ids[start[:, None] + np.arange(WINDOW)]
    worth = _suspicion(seen, y, distinct, at, length)
    rnd, mean, square, step = np.random.default_rng(seed), {}, {}, 0
    for turn in range(ROUNDS):
        order = np.lexsort((-worth, own))
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order])
        bad = y[own] == 1
        positive = np.flatnonzero(bad & ((rank == 0) | (rank == 1) & (worth > 0)))
        hard = np.flatnonzero(~bad & (rank < 2))
        other = rnd.permutation(np.flatnonzero(~bad))[: 2 * len(positive)]
        chosen = np.concatenate([positive, hard, other])
        for _ in range(EPOCHS):
            mixed = rnd.permutation(chosen)
            for i in range(0, len(mixed), BATCH):
                rows = mixed[i : i + BATCH]
                used, local = np.unique(at[rows], return_inverse=True)
                g = net.gradients([distinct[j] for j in used], local.reshape(len(rows), WINDOW), length[rows], y[own[rows]])
                step += 1
                for k, v in g.items():  # Adam
                    mean[k] = 0.9 * mean.get(k, 0) + 0.1 * v
                    square[k] = 0.999 * square.get(k, 0) + 0.001 * v * v
                    net.p[k] = (net.p[k] - 0.01 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        worth = net.window_logits(distinct, at, length)
    worst = np.full(len(y), -30.0)
    np.maximum.at(worst, own, worth)
    clean, toxic = worst[y == 0], worst[y == 1]
    # the threshold of the score lies between the bulk of either label, nearer to the toxic one
    low, high = np.quantile(clean, 0.99), np.quantile(toxic, 0.1)
    middle, width = low + 0.8 * (high - low), max(abs(high - low) / 2, 0.5)
    net.p["scale"] = np.array([2 / width], np.float32)
    net.p["shift"] = np.array([np.log(THRESHOLD / (1 - THRESHOLD)) - 2 / width * middle], np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, per_label: int = LEARN_PER_LABEL) -> Network:
    """Trains on at most per_label whole documents of each label; their texts come to the driver.

    An id with clashing labels counts as toxic; of rows that share a chosen id, the smallest text is learnt from.
    """
    marked = labels.filter("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(learnable(F.col("doc_id")))
    sample = learning_sample(marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", per_label)  # ids and labels alone
    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = sorted(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic").collect())
    return train([r.text for r in rows], [r.toxic for r in rows])


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score for each row of docs; one pass over whole texts, nothing is shuffled.

    Null and empty texts score 0, texts of any length count whole, rows that repeat or share an id are scored one by one, and rows that tie in score stay
    as they are. Columns but doc_id and text are ignored; an empty table gives none.
    """
    # the words of a bounded sample and fixed tables, as plain values: classes of this package can't be read where it isn't installed
    held = docs.sparkSession.sparkContext.broadcast({"vocabulary": net.vocabulary, "known": net.known, "p": net.p})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**held.value)
        for b in slices(batches, chars=1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(net.score(b.column("text").to_pylist()))], names=["doc_id", "score"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, as scored has it. An id without labels, or null, is no less scored; without labels to learn
    from no text is toxic."""
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
