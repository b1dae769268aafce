"""Two linear text models on hashed features: the quality classifier and the toxicity chain.

Both hash a batch of texts at once with numpy (common.Words) and score as sparse dot products: gather the features' weights, add up by text.

Quality: word unigrams and bigrams of the whole text (runs of punctuation are words too), hashed to 2**bits weights, each feature counted once an occurrence and divided by the
number of words; logistic regression by follow-the-regularised-leader updates (FTRL-proximal: a squared-gradient history and L1 and L2 terms for each weight).

Toxicity: a chain of categories in a fixed order. Features are the presence of hashed words and of their first bytes; the model of each
category also takes the log-odds of all earlier ones. For training, those come from models that did not see the document (out-of-fold predictions);
for scoring, from the models fitted on all. A document is rejected by the last category's probability.

The driver fits both on a bounded sample of labelled rows: at most `most` documents with the smallest hashes of their ids, `most` being a parameter.
Only hashed features of those rows' texts reach the driver. Scoring covers all rows and whole texts.

Cases: a null text counts as empty; an empty text has no features and the score of the bias. Repeated rows give repeated results. Documents
with no label, or null labels, are scored but not learnt from; with no labelled row at all the score is 0.5 (quality) and 0 (toxicity).
Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, PUNCTUATED, Words, cut, mix, reclaim, released, slices, text_or_empty

PREFIXES = (3, 4, 5, 6)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x for x in column.to_pylist()]


@dataclass
class Sparse:
    """Features of n texts: row[i] has feature at[i] with value[i]; rows ascend."""

    n: int
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, minlength=self.n)

    def parts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = np.searchsorted(self.row, np.arange(self.n + 1))
        return [(self.at[a:b], self.value[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def ngram_features(texts: list[bytes], bits: int) -> Sparse:
    """Word unigrams and bigrams, each occurrence worth 1 / words. Runs of punctuation are words; equal words next to each other, or with one between them, are one feature each, whatever the word."""
    w = Words(texts, PUNCTUATED)
    shift = np.uint64(64 - bits)
    two = np.flatnonzero(w.text[1:] == w.text[:-1])
    pair = np.where(w.hash[two] == w.hash[two + 1], np.uint64(1), w.hash[two] * np.uint64(3) + w.hash[two + 1])
    again = np.flatnonzero((w.text[2:] == w.text[:-2]) & (w.hash[2:] == w.hash[:-2]))
    h = np.concatenate([w.hash, mix(pair), np.full(len(again), mix(np.array([2], np.uint64)))]) >> shift
    row = np.concatenate([w.text, w.text[two], w.text[again]])
    return Sparse(w.n, row, h.astype(np.int64), 1.0 / np.maximum(w.count, 1)[row])


def presence_features(texts: list[bytes], bits: int) -> Sparse:
    """Which words, and first bytes of words, occur. Each counts once a text."""
    w = Words([x.decode("utf-8", "replace").lower().encode() for x in texts], LETTERS)
    hashes, rows = [w.hash], [w.text]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start >= n)
        hashes.append(mix(w.span(w.start[long], w.start[long] + n) + np.uint64(n)))
        rows.append(w.text[long])
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(bits)) | (np.concatenate(hashes) >> np.uint64(64 - bits))
    key = np.unique(key)
    return Sparse(w.n, (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.ones(len(key)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """Logistic regression by FTRL-proximal: weights are zero until their accumulated gradients exceed l1."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 1e-3):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, value: np.ndarray, y: float, weight: float = 1.0) -> None:
        """at: distinct features."""
        w = self.weights(at)
        g = (sigmoid(w @ value) - y) * value * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows, y: np.ndarray, rounds: int, most_weight: float = 1.0, part: np.ndarray | None = None) -> Ftrl:
        """Learns from the rows of part (none: all). Those of label 1 weigh as much more as they are rarer, up to most_weight."""
        part = np.arange(len(rows)) if part is None else part
        order, ones = np.random.Generator(np.random.PCG64(7)), max(float(np.sum(y[part])), 1.0)
        weight = min(most_weight, max(1.0, len(part) / ones - 1))
        for _ in range(rounds):
            for i in order.permutation(part):
                self.learn(*rows[i], y[i], weight if y[i] else 1.0)
        return self


def _merged(at: np.ndarray, value: np.ndarray, extra: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features with their values added up, and the extra ones."""
    u, k = np.unique(at, return_inverse=True)
    v = np.bincount(k, value, minlength=len(u))
    return np.append(u, [i for i, _ in extra]).astype(np.int64), np.append(v, [x for _, x in extra])


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], where: Column | None, most: int, id: str, text: str, features, bits: int):
    """Labels and features of at most `most` labelled rows. labels has one row an id at most (of repeated ones the smallest labels count)."""
    lab = labels.where(where) if where is not None else labels
    lab = lab.where(F.col(id).isNotNull()).groupBy(id).agg(*(F.min(c).alias(f"_y{i}") for i, c in enumerate(columns)))
    lab = lab.where(" and ".join(f"_y{i} is not null" for i in range(len(columns)))).withColumn("_order", F.xxhash64(id))
    chosen = F.broadcast(lab.orderBy("_order", id).limit(most))  # at most `most` small rows
    found = docs.select(F.col(id).alias(id), text_or_empty(text).alias("_text")).join(chosen, id)
    n = len(columns)

    def run(batches):
        for b in cut(batches):
            texts = _bytes(b.column(1))
            for s, e in slices(texts):
                f = features(texts[s:e], bits).parts()
                part = b.slice(s, e - s)
                merged = [_merged(a, v, []) for a, v in f]
                at = [x[0].astype("<i4").tobytes() for x in merged]
                value = [None if (x[1] == 1).all() else x[1].astype("<f4").tobytes() for x in merged]
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(2 + i) for i in range(n)), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["id", *(f"y{i}" for i in range(n)), "at", "value"])

    kinds = dict(found.dtypes)
    got = found.select(id, "_text", *(f"_y{i}" for i in range(n))).mapInArrow(released(run), ", ".join([f"id {kinds[id]}", *(f"y{i} {kinds[f'_y{i}']}" for i in range(n)), "at binary, value binary"]))
    rows = sorted(got.collect(), key=lambda r: (r["id"], bytes(r["at"])))
    # Views of the bytes that came: the sample is held once. Values that are all 1 don't come.
    feats = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f4") if r["value"] is not None else np.broadcast_to(np.float32(1), len(r["at"]) // 4)) for r in rows]
    return np.array([[float(r[f"y{i}"]) for i in range(n)] for r in rows]).reshape(len(rows), n), feats


# Quality


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None, most: int = 4000, bits: int = 18, rounds: int = 4, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """2**bits weights and the bias."""
    y, feats = sample(docs, labels, [label], where, most, id, text, ngram_features, bits)
    model = Ftrl(2**bits + 1)
    rows = [(np.append(a, 2**bits), np.append(v * _BOOST, 1.0)) for a, v in feats]
    model.fit(rows, y[:, 0] if len(y) else y, rounds)
    del feats, rows
    reclaim(docs.sparkSession)
    return model.weights(slice(None))


#: Word shares are small numbers; so scaled they move as fast as the bias.
_BOOST = 30.0


def score_quality(docs: DataFrame, weights: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score of each row."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers, whatever the corpus

    def run(batches):
        w = shared.value
        for b in cut(batches):
            texts, out = _bytes(b.column(1)), []
            for s, e in slices(texts):
                out.append(sigmoid(ngram_features(texts[s:e], bits).dot(w) * _BOOST + w[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], names=[id, "score"])

    return docs.select(F.col(id).alias(id), text_or_empty(text).alias("_text")).mapInArrow(released(run), f"`{id}` {dict(docs.dtypes)[id]}, score double")


# Toxicity


@dataclass
class Chain:
    """weights[k]: 2**bits features, the log-odds of the k categories before, and the bias."""

    categories: list[str]
    bits: int
    weights: list[np.ndarray]

    def probabilities(self, f: Sparse) -> list[np.ndarray]:
        size, found = 2**self.bits, []
        for k, w in enumerate(self.weights):
            z = f.dot(w[:size]) + w[-1] + sum(w[size + j] * _odds(p) for j, p in enumerate(found))
            found.append(sigmoid(z))
        return found


def _odds(p):
    p = np.clip(p, 0.001, 0.999)
    return np.log(p / (1 - p)) / 4


class _Linked:
    """Rows of the sample for one category: features, then the log-odds of the categories before, then the bias. Made when asked for, so that the sample is held once."""

    def __init__(self, feats: list[tuple[np.ndarray, np.ndarray]], earlier: np.ndarray, size: int):
        self.feats, self.extra = feats, np.arange(size, size + earlier.shape[1] + 1, dtype=np.int32)
        self.tail = np.column_stack([earlier, np.ones(len(feats))]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.feats)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, value = self.feats[i]
        return np.concatenate([at, self.extra]), np.concatenate([value, self.tail[i]])


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int = 10_000, bits: int = 20, folds: int = 3, rounds: int = 4, id: str = "doc_id", text: str = "text") -> Chain:
    """categories: name -> 0/1 expression over labels, in the order of the chain."""
    names = list(categories)
    lab = labels.select(id, *(c.cast("int").alias(n) for n, c in categories.items()))
    y, feats = sample(docs, lab, names, None, most, id, text, presence_features, bits)
    size, chain, earlier = 2**bits, Chain(names, bits, []), np.zeros((len(feats), 0))
    fold = np.arange(len(feats)) % folds
    for k in range(len(names)):
        rows = _Linked(feats, earlier, size)
        # Few features matter, so l1 keeps the rest at zero.
        fit = lambda part, k=k, rows=rows: Ftrl(size + k + 1, alpha=0.3, l1=3.0, l2=0.1).fit(rows, y[:, k], rounds, 4.0, part).weights(slice(None))
        if not len(feats):
            chain.weights.append(np.append(np.zeros(size + k), -35.0))
            continue
        chain.weights.append(fit(np.arange(len(feats))))
        held = np.zeros(len(feats))
        for f in range(folds):
            out = np.flatnonzero(fold == f)
            w = fit(np.flatnonzero(fold != f))
            held[out] = [sigmoid(w[at] @ value) for at, value in map(rows.__getitem__, out)]
        earlier = np.column_stack([earlier, _odds(held)])
        del rows, fit, w
    del feats
    reclaim(docs.sparkSession)
    return chain


def score_chain(docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and p_<category> of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        chain = shared.value
        for b in cut(batches):
            texts, out = _bytes(b.column(1)), [np.zeros((len(names), 0))]
            for s, e in slices(texts):
                out.append(np.array(chain.probabilities(presence_features(texts[s:e], chain.bits))))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, np.concatenate(out, axis=1))], names=[id, *names])

    return docs.select(F.col(id).alias(id), text_or_empty(text).alias("_text")).mapInArrow(released(run), ", ".join([f"`{id}` {dict(docs.dtypes)[id]}", *(f"{n} double" for n in names)]))


def without_toxic(docs: DataFrame, chain: Chain, threshold: float, text: str = "text") -> DataFrame:
    """docs' rows whose last category has a probability below threshold, with docs' columns: scored in the same pass, without a join."""
    shared, name = docs.sparkSession.sparkContext.broadcast(chain), text

    def run(batches):
        chain = shared.value
        for b in cut(batches):
            texts = [x or b"" for x in _bytes(b.column(b.schema.get_field_index(name)))]
            for s, e in slices(texts):
                p = chain.probabilities(presence_features(texts[s:e], chain.bits))[-1]
                yield b.slice(s, e - s).filter(pa.array(p < threshold))

    return docs.mapInArrow(released(run), docs.schema)
