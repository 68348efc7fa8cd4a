"""Operator 6: language identification by nearest centroid.

A text is the TF-IDF vector of its byte trigrams in lower case (white space, digits and punctuation of ASCII are one
symbol), hashed to DIMENSIONS and scaled to length 1. Each language has a few centroids, found by spherical
k-means in a bounded sample of its learnable documents. A text gets the language of the centroid with the largest
cosine, which is the score; it is rejected if that cosine is below a share of what nearly all learnt texts of the language reach.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import learnable, learning_sample
from .shingles import give_back, slices

DIMENSIONS = 1 << 13
#: Bound of the sample: documents of each language that are learnt from.
LEARN_PER_LANGUAGE = 400
CENTROIDS = 4
#: A centroid of fewer learnt documents is given up, as it stands for outliers.
LEAST_MEMBERS = 8
#: Texts are rejected below this share of the cosine that all but this part of a language's learnt documents reach.
REJECT_SHARE, REJECT_BELOW = 0.5, 0.01
#: Texts whose dense vectors are held at a time, and bytes of them.
ROWS, BYTES = 128, 1 << 19
UNDETERMINED = "und"

_SYMBOLS = np.arange(256, dtype=np.uint8)
_SYMBOLS[:65] = _SYMBOLS[91:97] = _SYMBOLS[123:128] = 32
_CANDIDATE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _CANDIDATE.finditer(text))


def trigram_ids(text: str | None) -> np.ndarray:
    """The dimension of each trigram of a whole text, with a space at each end."""
    a = _SYMBOLS[np.frombuffer(b" " + (text or "").lower().encode() + b" ", dtype=np.uint8)].astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    code = code[(code & np.uint32(0xFFFF)) != 0x2020]  # runs of spaces say nothing
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(19)


def counts(texts: list[str | None]) -> np.ndarray:
    ids = [trigram_ids(t) for t in texts]
    own = np.repeat(np.arange(len(ids), dtype=np.int64) * DIMENSIONS, [len(i) for i in ids])
    flat = np.bincount(own + np.concatenate(ids), minlength=len(ids) * DIMENSIONS)
    return flat.reshape(len(ids), DIMENSIONS).astype(np.float32)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, rows of length 1 (or 0 without a trigram)."""
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # one for each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine of each centroid below which texts are rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine of its centroid, and whether the text is rejected."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        cos = np.clip(weighted(counts(texts), self.idf) @ self.centroids.T, 0, 1)
        letters = np.array([has_letter(t) for t in texts])
        best = cos.argmax(axis=1)
        score = np.where(letters, cos[np.arange(len(texts)), best], 0.0).astype(np.float64)
        return [self.languages[i] if ok else UNDETERMINED for i, ok in zip(best, letters, strict=True)], score, ~letters | (score < self.least[best])


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun with rows drawn by their distance from those drawn before; small clusters join the others."""
    rnd = np.random.default_rng(17)
    picked = [int((x @ x.mean(axis=0)).argmax())]
    while len(picked) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[picked].T).max(axis=1), 0).astype(np.float64)
        if far.sum() <= 1e-6:
            break
        picked.append(int(rnd.choice(len(x), p=far / far.sum())))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        members = np.bincount(own, minlength=len(c))
        stay = members >= min(LEAST_MEMBERS, members.max())
        c = np.stack([x[own == j].mean(axis=0) for j in np.flatnonzero(stay)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def learn(docs: DataFrame, per_language: int = LEARN_PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """Fits the centroids. Sparse counts of at most per_language documents of each language come to the driver.

    Ids are chosen by a hash of id and language alone; texts are met where they lie, and not shuffled. Rows without an id aren't
    chosen; of rows that share a chosen id and language, the one with the smallest hash of its text is learnt from.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    sample = learning_sample(known.select("doc_id", "lang"), "lang", per_language)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"])  # per_language ids a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BYTES, ROWS):
            texts = b.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if has_letter(t)]
            seen = [np.unique(trigram_ids(texts[i]), return_counts=True) for i in at]
            lang = b.column("lang").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array([lang[i] for i in at], pa.string()), pa.array([zlib.crc32(texts[i].encode()) for i in at], pa.int64()), pa.array([s[0].astype(np.int32) for s in seen], pa.list_(pa.int32())), pa.array([s[1].astype(np.int32) for s in seen], pa.list_(pa.int32()))],
                names=["doc_id", "lang", "crc", "ids", "n"],
            )

    counted = sample.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, crc long, ids array<int>, n array<int>")
    one = counted.groupBy("doc_id", "lang").agg(F.min(F.struct("crc", "ids", "n")).alias("x"))  # a row for each id of the sample
    rows = sorted((r.lang, r.ids, r.n) for r in one.select("lang", "x.ids", "x.n").collect())
    if not rows:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(0))
    tf = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for i, (_, ids, n) in enumerate(rows):
        tf[i, ids] = n
    idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 1
    x = weighted(tf, idf)
    langs = np.array([r[0] for r in rows])
    names, cents, least = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        c = _clusters(own, k)
        names += [lang] * len(c)
        cents.append(c)
        least += [REJECT_SHARE * float(np.quantile((own @ c.T).max(axis=1), REJECT_BELOW))] * len(c)
    return Model(names, np.concatenate(cents).astype(np.float32), idf, np.array(least))


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs, lang_pred, score and rejected for each row.

    Null texts and texts without a letter are `und` with score 0 and rejected. Without anything to learn from all are. Works
    on whole texts in one pass; nothing is shuffled. Of centroids that tie the first counts, by language in alphabetical order. Rows that repeat or share an id
    are judged one by one; columns that aren't in keep are ignored, and keep must not hold lang_pred, score or rejected (see known_languages for
    columns of any name). An empty table gives no rows.
    """
    # DIMENSIONS floats for each centroid; plain values, as classes of this package can't be read where it isn't installed
    held = docs.sparkSession.sparkContext.broadcast(asdict(model))
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kept = [f for f in source.schema if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value)
        for b in slices(batches, BYTES, ROWS):
            lang, score, rejected = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*(f.name for f in kept), "lang_pred", "score", "rejected"])
        give_back()

    return source.mapInArrow(run, schema)


def known_languages(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text isn't rejected, with the columns of docs whatever their names."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return identify(packed, model, ["row"]).filter("not rejected").select("row.*")


def held_out(doc_id: Column) -> Column:
    return ~learnable(doc_id)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    out = identify(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
