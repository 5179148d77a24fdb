"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's features are the character n-grams of its lower-cased letters (words in boundary
marks), hashed into BUCKETS rows of an embedding table; their mean goes through one
linear layer and a softmax. Embeddings and weights are trained by stochastic gradient
descent in numpy on a bounded sample of at most SAMPLE labelled rows. Each language gets the same share of it, and
what a rare one leaves goes to the others; its rows are those of least seeded hash of id and text, equal rows
once. A row brings the n-gram counts of its whole text. A part of the sample that training never sees calibrates
the model: a temperature by likelihood, and the least score from which on predictions err no more than
MAX_ERROR; below it they are rejected.

Predictions read whole texts. Because the layer is linear, table and weights fold into
one logit row per bucket, so a text is one gather and one mean however long it is. The model
travels to the executors in the function's closure: BUCKETS rows times the labels found,
whatever the input's size.

Edge cases: null texts and texts without a letter are "und" with score 0; rows without
lang are predicted like others and never learned from; with no labelled row at all every
row is "und"; repeated rows get equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, slices

BUCKETS = 1 << 15
DIMENSION = 12
ORDERS = (1, 2, 3, 4)
#: Most labelled rows that the model learns from, calibration included.
SAMPLE = 3_000
EPOCHS = 6
#: Least number of training steps: small samples are gone over more often.
STEPS = 4_000
RATE = 0.5
SEED = 5
#: Share of errors among accepted calibration rows that is borne.
MAX_ERROR = 0.01
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PIECE = 1 << 20


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, in pieces of bounded size."""
    line = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    for at in range(0, len(line), _PIECE):
        code = np.frombuffer(line[at : at + _PIECE + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = np.full(len(code), 0xCBF29CE484222325, np.uint64)
        for order in range(1, max(ORDERS) + 1):
            if order > len(code):
                break
            h = (h[: len(code) - order + 1] ^ code[order - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            if order in ORDERS:
                yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int32)


def histogram(text: str) -> bytes:
    """The distinct n-gram buckets of the whole text (16 bits each), then their counts (32 bits each)."""
    total = np.zeros(BUCKETS, np.int64)
    for piece in grams(text):
        total += np.bincount(piece, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype("<u2").tobytes() + total[found].astype("<u4").tobytes()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 6
    counts = np.frombuffer(packed, "<u4", n, 2 * n)
    return np.frombuffer(packed, "<u2", n).astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # a row of label scores per bucket
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for piece in grams(text):
            if len(piece) > BUCKETS:
                total += np.bincount(piece, minlength=BUCKETS) @ self.logits
            else:
                total += self.logits[piece].sum(axis=0, dtype=np.float64)
            n += len(piece)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not _LETTER.search(text):
            return "und", 0.0
        p = _softmax(self.scores(text)[None] / self.temperature)[0]
        return self.labels[int(p.argmax())], float(p.max())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def rejection_floor(sure: np.ndarray, right: np.ndarray) -> float:
    """The least score among right predictions from which on errors are at most MAX_ERROR; above all scores if there is none."""
    order = np.argsort(-sure, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    able = np.flatnonzero((errors <= MAX_ERROR) & right[order])
    return float(sure[order][able[-1]]) if len(able) else float(np.nextafter(sure.max(initial=1.0), 2.0))


def train(rows: list[dict]) -> Model:
    """A calibrated model from rows of grams (as histogram() gives them) and lang."""
    rows = [(*_unpacked(r["grams"]), r["lang"]) for r in rows if r["grams"]]
    labels = sorted({y for *_, y in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(SEED)
    rng.shuffle(rows)
    held = rows[: len(rows) // 5]
    learn = rows[len(rows) // 5 :] or rows
    number = {y: k for k, y in enumerate(labels)}
    counts = np.bincount([number[y] for *_, y in learn], minlength=len(labels))
    weight = (len(learn) / (len(labels) * np.maximum(counts, 1))) ** 0.5  # rare languages count a little more
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIMENSION, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(learn)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(learn)):
            g, share, y = learn[k]
            mean = share @ table[g]
            error = _softmax(mean @ layer + bias)
            error[number[y]] -= 1
            error *= weight[number[y]]
            down = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            table[g] -= (rate * min(20.0, 1 / float(share @ share)) * share)[:, None] * down.astype(np.float32)  # no step further than the whole error
    model = Model(labels, (table @ layer).astype(np.float32), bias.astype(np.float64))
    check = held or learn
    raw = np.array([share @ model.logits[g] + model.bias for g, share, _ in check])
    truth = np.array([number[y] for *_, y in check])
    loss = lambda t: -np.log(_softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    p = _softmax(raw / model.temperature)
    model.floor = rejection_floor(p.max(axis=1), p.argmax(axis=1) == truth)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each label: equal shares of most, what small labels leave shared by the others; at most `most` labels, the frequent ones."""
    out, left = {}, most
    small_first = sorted(sorted(counts, key=lambda y: (-counts[y], y))[:most], key=lambda y: (counts[y], y))
    for k, y in enumerate(small_first):
        out[y] = min(counts[y], left // (len(small_first) - k))
        left -= out[y]
    return out


def sample(docs: DataFrame, most: int = SAMPLE) -> list[dict]:
    """At most `most` rows (h, grams, lang) of docs (text, lang, doc_id) that are not held out and have a lang, by quotas."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(SEED), "doc_id", "text")
    hashed = able.select(order.alias("h"), "text", "lang")
    # equal rows share a hash and come once, so they are counted once; the counts are right within some per cent
    different = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    counts = {r["lang"]: r["n"] for r in different.orderBy(F.desc("n"), "lang").limit(most).collect()}
    quota = quotas(counts, most)
    if not quota:
        return []
    # a range of hashes that holds half as many rows again as the quota, and some, then the least hashes
    shares = docs.sparkSession.createDataFrame([(y, min(1.0, (1.5 * k + 20) / counts[y])) for y, k in quota.items()], "lang string, share double")
    chosen = hashed.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned("h", 11).cast("double") * F.lit(2.0**-53) < F.col("share"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            hashes, texts = batch.column("h").to_pylist(), batch.column("text").to_pylist()
            rows = [k for k, h in enumerate(hashes) if not (h in seen or seen.add(h))]
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(rows, pa.int64())), pa.array([histogram(texts[k]) for k in rows], pa.binary()), batch.column("lang").take(pa.array(rows, pa.int64()))], ["h", "grams", "lang"])

    once = chosen.select("h", "text", "lang").mapInArrow(reduce, "h long, grams binary, lang string").groupBy("h", "lang").agg(F.first("grams").alias("grams"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h"))
    rows = once.withColumn("place", place).orderBy("place", "lang").limit(2 * most).collect()
    return sorted(({"h": r["h"], "lang": r["lang"], "grams": bytes(r["grams"])} for r in rows if r["place"] <= quota[r["lang"]]), key=lambda r: (r["h"], r["lang"]))[:most]


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """A model from a sample of docs; rows without lang teach nothing."""
    return train(sample(docs, most))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for docs; only text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            score = [s for _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([y for y, _ in found], pa.string()), pa.array(score, pa.float64()), pa.array([y == "und" or s < model.floor for y, s in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
