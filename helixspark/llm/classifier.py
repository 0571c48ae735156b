"""A quality classifier: random-indexing word vectors, pooled per document, under a small calibrated network.

Random indexing: each word has a fixed sparse index vector, and its word vector is the sum of the index vectors of its
neighbours over the whole corpus. Words fall into a fixed number of hashed classes, by their letters and by their shape, so
the table of word vectors has a fixed size; the sums are integers, pre-added in each task and then by class. A document's
vector pools those of its words. The network has one hidden layer, is trained by numpy on a bounded number of labelled
rows, and its temperature is fitted on labelled rows kept out of the training.

Defined results: null and empty texts have the vector of no words and are scored like any other. Null identifiers and
null labels teach nothing; of contradicting labels of one document the smallest counts. Repeated rows get equal scores. Very long texts and words are read whole. With no
labelled row every score is 0.5; an empty table gives an empty result. Other columns are carried along, except a score
column that is there already.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of
from .words import give_back, remembers, slices, turn_of, words_of

LETTERS, SHAPES, DIM, REACH = 1 << 14, 1 << 11, 32, 2
CLASSES = LETTERS + SHAPES
#: Labelled rows at most that the network is fitted on: those of the smallest hashes.
FIT_ROWS = 20_000
HIDDEN = 32
_EXTRA = 6
_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"[0-9]+")
_MARKS = re.compile(r"([^Aa0])\1{2,}")
_ENDS = set(".,;:!?")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def held_out(id_col: str) -> Column:
    """Documents whose labels are never learnt from: a fifth, by the checksum of the identifier."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def classes_of(word: str) -> tuple[int, int]:
    """The class of a word's letters and that of its shape, both of the whole word however long it is."""
    end = word[-1:]
    core = word[:-1] if end in _ENDS else word
    if core.isalpha():  # the common case, without patterns
        shape = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[1:].islower() else "AaA"
        if end in _ENDS:
            shape += end
        letters = core.lower()
    else:
        shape = _MARKS.sub(r"\1\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))))
        letters = _NOT_LETTER.sub("", word).lower()
    return _hash(letters) % LETTERS, LETTERS + _hash(shape) % SHAPES


class _Words:
    """Classes of words met lately."""

    def __init__(self, size: int = 300_000):
        self.size, self.known = size, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        """An array (n, 2) of classes."""
        turn_of("classifier")
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > self.size:
                known.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    x = known.get(w)
                    if x is None:
                        a, b = classes_of(w)
                        x = a << 32 | b
                        if len(w) < 64:
                            known[w] = x
                    found[i] = x
        both = np.array(found, dtype=np.int64)
        return np.stack([both >> 32, both & 0xFFFFFFFF], axis=1)


_words = _Words()
remembers("classifier", lambda: _words.known.clear())


def index_vectors() -> np.ndarray:
    """(CLASSES, DIM) of -1, 0 and 1, four of them not 0 in each row."""
    rng = np.random.default_rng(7)
    place = rng.random((CLASSES, DIM)).argsort(axis=1)[:, :4]
    out = np.zeros((CLASSES, DIM), dtype=np.int8)
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], dtype=np.int8), (CLASSES, 4)), axis=1)
    return out


def contexts(texts: list[str], index: np.ndarray, total: np.ndarray) -> None:
    """Add the neighbours' index vectors of all words of the texts to total, (CLASSES, DIM)."""
    split = [words_of(x) for x in texts]
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = [w for ws in split for w in ws]
    if not flat:
        return
    cls = _words(flat)
    doc = np.repeat(np.arange(len(split)), lengths)
    x = (index[cls[:, 0]] + index[cls[:, 1]]).astype(np.float32)
    near = np.zeros_like(x)
    for d in range(1, min(REACH, len(flat) - 1) + 1):
        same = (doc[d:] == doc[:-d])[:, None]
        near[d:] += x[:-d] * same
        near[:-d] += x[d:] * same
    for column in (0, 1):
        c = cls[:, column].astype(np.uint16)
        order = np.argsort(c, kind="stable")
        c = c[order]
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        total[c[start]] += np.add.reduceat(near[order], start, axis=0)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of all classes over the whole corpus, of unit length. Its size is fixed, so it can be collected."""
    ship(docs.sparkSession)
    names = [f"d{k}" for k in range(DIM)]

    def run(batches):
        index, total = index_vectors(), np.zeros((CLASSES, DIM))
        for batch in batches:
            for part in slices(batch.column(0).to_pylist()):
                contexts(part, index, total)
        used = np.flatnonzero(np.any(total != 0, axis=1))
        sums = total[used].astype(np.int64)
        for at in range(0, len(used), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(used[at : at + 4096], pa.int32()), *(pa.array(sums[at : at + 4096, k]) for k in range(DIM))], names=["class", *names])

    parts = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "class int, " + ", ".join(f"{x} long" for x in names))
    found = parts.groupBy("class").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    out = np.zeros((CLASSES, DIM), dtype=np.float32)
    if len(found):
        v = found[names].to_numpy(dtype=np.float64)
        out[found["class"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Document vectors: means over the words of both word vectors, and figures of how varied the words are."""
    split = [words_of(x) for x in texts]
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    out = np.zeros((len(texts), 2 * DIM + _EXTRA), dtype=np.float32)
    flat = [w for ws in split for w in ws]
    if flat:
        cls = _words(flat)
        full = np.flatnonzero(lengths)
        start = (np.cumsum(lengths) - lengths)[full]
        n = lengths[full][:, None]
        for k in (0, 1):
            out[full, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[cls[:, k]], start, axis=0) / n
        again = np.zeros(len(flat), dtype=np.float32)
        doc = np.repeat(np.arange(len(split)), lengths)
        again[1:] = (cls[1:, 0] == cls[:-1, 0]) & (doc[1:] == doc[:-1])
        out[full, 2 * DIM] = np.add.reduceat(again, start) / n[:, 0]
    distinct = np.array([len(set(ws)) for ws in split])
    lines = [[y for y in x.split("\n") if y] for x in texts]
    out[:, 2 * DIM + 1] = np.log1p(lengths) / 4
    out[:, 2 * DIM + 2] = np.log1p(distinct) / 4
    out[:, 2 * DIM + 3] = distinct / np.maximum(lengths, 1)
    out[:, 2 * DIM + 4] = [len(set(x)) / max(len(x), 1) for x in lines]
    out[:, 2 * DIM + 5] = np.linalg.norm(out[:, :DIM], axis=1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray, steps: int = 1500, seed: int = 5) -> Network:
    """check: rows kept for the temperature and for choosing when to stop."""
    rng = np.random.default_rng(seed)
    train = ~check if check.any() and (~check).any() else np.ones(len(y), dtype=bool)
    check = check if check.any() else train
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    xs, ys = (x[train] - mean) / scale, y[train].astype(float)
    best, kept = np.inf, None
    for step in range(1, steps + 1):
        i = rng.integers(0, len(ys), min(512, len(ys)))
        a = np.tanh(xs[i] @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - ys[i]) / len(i)
        back = np.outer(d, p[2]) * (1 - a * a)
        grads = [xs[i].T @ back + 1e-4 * p[0], back.sum(axis=0), a.T @ d + 1e-4 * p[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if step % 50 == 0 or step == steps:
            net = Network(mean, scale, *(a.copy() for a in p[:3]), float(p[3][0]))
            if (now := _loss(net.logits(x[check]), y[check])) < best:
                best, kept = now, net
    z = kept.logits(x[check])
    kept.temperature = float(min(np.geomspace(0.3, 10, 120), key=lambda t: _loss(z / t, y[check])))
    return kept


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network | None

    def score(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return np.concatenate([self.network.score(pool(x, self.vectors)) for x in slices(texts)]) if len(texts) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Classifier:
    """Word vectors from all docs; the network from at most fit_rows labelled ones that aren't held out."""
    ship(docs.sparkSession)
    vectors = word_vectors(docs, text_col)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IN (0, 1)").groupBy("__id").agg(F.min("__y").alias("__y"))
    known = known.filter(~held_out("__id")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    width = 2 * DIM + _EXTRA

    def run(batches):
        for batch in batches:
            ids, ys, texts = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            for part in slices(texts):
                x = pool(part, shared.value)
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + n], batch.schema.field(0).type), pa.array(ys[at : at + n], pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float32()))], names=["id", "y", "x"])
                at += n

    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(known), "__id")  # fit_rows rows at most
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("__id", "__y", "__text").dropDuplicates(["__id"]).mapInArrow(run, f"id {kind}, y int, x array<float>").toPandas()
    if found.empty:
        return Classifier(vectors, None)
    found = found.sort_values("id")
    x, y = np.stack(found["x"].to_numpy()), found["y"].to_numpy()
    check = np.array([_hash(f"check {i}") % 5 == 0 for i in found["id"]])
    model = Classifier(vectors, fit(x, y, check))
    del found, x
    shared.unpersist()
    give_back()  # the driver has little beside its heap
    return model


def scored(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.withColumn(score_col, score(text_of(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs that score at least so much, with their columns."""
    model = train(docs, labels, id_col, text_col)
    bare = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__text"))
    return scored(bare, model, "__text", "__score").filter(F.col("__score") >= least).select("__row.*")
