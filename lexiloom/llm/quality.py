"""A supervised subword-embedding classifier of text quality.

A text is the average of learned vectors of its hashed features, the words as
they stand, their character 3- to 5-grams and the pairs of neighbouring words
(a word that repeats the one before is the pair `=`), and a softmax reads the
label off that average.  Training is stochastic gradient descent in numpy on the
driver, over at most FIT_ROWS labelled rows (those with the least hash of their
doc_id; whole texts).  Scoring covers every row: the softmax of an average is
linear in the features before its last step, so each bucket's vector is folded
to one number, and a word's share (with its n-grams) is looked up once known.

Null and empty texts have no features and score by the softmax's bias; without
labelled rows of both kinds every score is the share of label 1 (0.5 if there is
none); repeated rows score alike; labels that are null are not used; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_bytes, table
from .tokens import text_groups

#: Most labelled rows that the fit reads.
FIT_ROWS = 4000
#: Most bytes of their texts, and of one of them.
FIT_BYTES, FIT_TEXT = 64_000_000, 4_000_000
BUCKETS, DIMENSIONS, EPOCHS, LEAST_STEPS, RATE, GROUP, SEED = 1 << 18, 8, 4, 1000, 0.5, 16, 7  # few rows are gone through more often
KEEP = 0.7
CACHE_WORDS = 120_000
#: Characters scored at a time.
GROUP_CHARS = 1_500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return x ^ (x >> _TURN)


class Features:
    """Buckets of words and n-grams; per word its hash and its features' buckets."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word; buckets of all features of all words; and to which word each belongs."""
        joined = "".join(f"<{w}>" for w in words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        term = _mixed(points + np.uint64(1) + (place.astype(np.uint64) << np.uint64(22)))
        whole = np.add.reduceat(term, np.cumsum(sizes) - sizes) if len(words) else np.zeros(0, np.uint64)
        whole = _mixed(whole)
        buckets, owners = [whole % self.buckets], [np.arange(len(words))]
        for n in (3, 4, 5):
            if len(points) < n:
                continue
            gram = np.zeros(len(points) - n + 1, np.uint64)
            for i in range(n):
                gram = _mixed(gram + points[i : len(points) - n + 1 + i] + np.uint64(n))
            inside = owner[: len(gram)] == owner[n - 1 :]
            buckets.append(gram[inside] % self.buckets)
            owners.append(owner[: len(gram)][inside])
        return whole, np.concatenate(buckets).astype(np.int64), np.concatenate(owners)

    def of_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        pair = _mixed(first * np.uint64(3) + second)
        pair[first == second] = np.uint64(1)
        return (pair % self.buckets).astype(np.int64)


class Model:
    def __init__(self, features: Features, weights: np.ndarray, bias: float):
        """weights[bucket]: what its vector adds to the logit of label 1 over label 0."""
        self.features, self.weights, self.bias = features, weights, bias
        self._begin()

    def __getstate__(self) -> dict:
        return {"features": self.features, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _begin(self) -> None:
        self.index: dict[str, int] = {}
        self.hash, self.share, self.count = np.zeros(1024, np.uint64), np.zeros(1024), np.zeros(1024)

    def _learn(self, fresh: list[str]) -> None:
        start = len(self.index)
        while start + len(fresh) > len(self.hash):
            self.hash, self.share, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.share, self.count))
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            whole, buckets, owner = self.features.of_words(part)
            here = slice(start + at, start + at + len(part))
            self.hash[here] = whole
            self.share[here] = np.bincount(owner, self.weights[buckets], len(part))
            self.count[here] = np.bincount(owner, minlength=len(part))
        self.index.update(zip(fresh, range(start, start + len(fresh)), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        out = np.zeros(len(texts))
        distinct = set().union(*split) if split else set()
        fresh = sorted(w for w in distinct if w not in self.index)
        if len(self.index) + len(fresh) > CACHE_WORDS:
            self._begin()
            fresh = sorted(distinct)
        if fresh:
            self._learn(fresh)
        get = self.index.__getitem__
        for i, found in enumerate(split):
            logit = self.bias
            if found:
                at = np.fromiter(map(get, found), np.int64, len(found))
                h = self.hash[at]
                pairs = self.weights[self.features.of_pairs(h[:-1], h[1:])]
                logit += (self.share[at].sum() + pairs.sum()) / (self.count[at].sum() + len(pairs))
            out[i] = logit
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _bags(features: Features, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their shares of the average."""
    out = []
    for t in texts:
        found = t.split()
        if not found:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        names, back, times = np.unique(np.array(found, dtype=object).astype(str), return_inverse=True, return_counts=True)
        whole, buckets, owner = features.of_words(names.tolist())
        h = whole[back]
        every = np.concatenate([buckets, features.of_pairs(h[:-1], h[1:])])
        weight = np.concatenate([times[owner], np.ones(len(found) - 1)])
        distinct, at = np.unique(every, return_inverse=True)
        share = np.bincount(at, weight, len(distinct))
        out.append((distinct, (share / share.sum()).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[int], seed: int = SEED) -> Model:
    features, y = Features(), np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Model(features, np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    bags, rng = _bags(features, texts), np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    head, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(y) // GROUP)))
    steps = epochs * -(-len(y) // GROUP)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), GROUP):
            rows = order[at : at + GROUP]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            sizes = np.array([len(bags[r][0]) for r in rows])
            buckets, share = (np.concatenate([bags[r][j] for r in rows]) for j in (0, 1))
            owner = np.repeat(np.arange(len(rows)), sizes)
            gathered = vectors[buckets] * share[:, None]
            hidden = np.stack([np.bincount(owner, gathered[:, j], len(rows)) for j in range(DIMENSIONS)], 1).astype(np.float32)
            logit = hidden @ head + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1  # gradient of the logits
            back = p @ head.T
            head -= rate * hidden.T @ p
            bias -= rate * np.float32(0.05) * p.sum(0)
            np.subtract.at(vectors, buckets, rate * len(rows) * share[:, None] * back[owner])
    return Model(features, (vectors @ (head[:, 1] - head[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most `rows` labelled rows that are not held out, and on at most FIT_BYTES of their texts, in the order of a hash. A text over FIT_TEXT bytes is skipped, so none shuts out those behind it."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.min("quality").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    found = doc_bytes(docs).join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"), F.min("y").alias("y"))  # at most `rows` ids; of rows that repeat an id the least text
    upto = F.sum(F.length("t")).over(Window.orderBy(F.xxhash64("k"), "k"))
    picked = sorted(found.where(F.length("t") <= FIT_TEXT).withColumn("upto", upto).where(F.col("upto") <= FIT_BYTES).select("k", "t", "y").collect(), key=lambda r: r.k)
    return fit([str(bytes(r.t), "utf-8") for r in picked], [int(r.y == 1) for r in picked])


_OPEN: dict[int, Model] = {}


def _model(broadcast) -> Model:
    """The worker's copy, with the words that it knows already."""
    if broadcast.value is not _OPEN.get(0):
        _OPEN[0] = broadcast.value
    return _OPEN[0]


def _scored(model: Model, texts: list[bytes | str | None]) -> np.ndarray:
    plain = [t.decode() if isinstance(t, bytes) else t or "" for t in texts]
    parts = [model.scores(plain[part]) for part in text_groups([len(t) for t in plain], GROUP_CHARS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_scored(_model(sent), batch.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = doc_bytes(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score")


def keep_good(docs: DataFrame, model: Model, least: float = KEEP, text: str = "text") -> DataFrame:
    """docs that score `least` or more; all columns stay."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(_model(sent), batch.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
