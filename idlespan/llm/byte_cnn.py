"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes that overlap by the widest filter less one, so that every run of bytes a filter can
see lies in some window.  Bytes (A-Z lower-cased) are embedded, filters of several widths pass over them, each keeps its largest answer
in the window, and softmax over those gives the window's class probabilities.  The probabilities of a text are the
mean over its windows, weighted by their bytes.

Training takes a bounded sample: at most ``SAMPLE`` windows a language, chosen by hash from all labelled texts and from
anywhere in them.  Sample and training are bounded by ``SAMPLE`` times the number of languages, whatever the corpus; the training is one
small task, and its weights (some 20 KB) go to the scoring tasks.  Scoring is inside the row: no shuffle, no join.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .tokens import batches_of

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
EMBEDDING = 8
SAMPLE = 2048
EPOCHS = 6
BATCH = 64
RATE = 4e-3
SEED = 12
MOST_PER_TEXT = 16
OVERLAP = max(WIDTHS) - 1
STEP = WINDOW - OVERLAP
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class ByteNet:
    """The network: embedding (byte 0 is padding and stays zero), filters side by side in one matrix, softmax weights.

    Filters narrower than the widest have zero rows behind their width, so that one product serves all of them.
    """

    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.classes = classes
        self.mask = np.zeros((wide * EMBEDDING, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w * EMBEDDING, i * FILTERS:(i + 1) * FILTERS] = 1
        self.weights = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
                        "filters": (rng.normal(0, 0.25, self.mask.shape) * self.mask).astype(np.float32),
                        "bias": np.zeros(n, np.float32),
                        "top": rng.normal(0, 0.1, (n, len(classes))).astype(np.float32),
                        "offset": np.zeros(len(classes), np.float32)}
        self.weights["embedding"][0] = 0

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, widest filter x embedding), a view of the embedded bytes."""
        x = self.weights["embedding"][windows]
        n, length, d = x.shape
        return np.lib.stride_tricks.as_strided(x, (n, length - max(WIDTHS) + 1, max(WIDTHS) * d), x.strides[:2] + x.strides[2:])

    def answers(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every filter's answer at every place, and the patches it saw."""
        seen = self.patches(windows)
        n, places, k = seen.shape
        flat = np.ascontiguousarray(seen).reshape(n * places, k)
        return (flat @ self.weights["filters"]).reshape(n, places, -1), seen

    def classify(self, pooled: np.ndarray) -> np.ndarray:
        """Class probabilities from the largest answers."""
        w = self.weights
        z = np.maximum(pooled + w["bias"], 0) @ w["top"] + w["offset"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return self.classify(self.answers(windows)[0].max(axis=1))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy.  Only the place of a filter's largest answer passes one on."""
        w = self.weights
        z, seen = self.answers(windows)
        best = z.argmax(axis=1)                                            # (windows, filters)
        rows = np.arange(len(windows))[:, None]
        pooled = np.take_along_axis(z, best[:, None, :], axis=1)[:, 0]
        kept = np.maximum(pooled + w["bias"], 0)
        d_out = self.classify(pooled)
        d_out[rows[:, 0], labels] -= 1
        d_out /= len(windows)
        d_pool = (d_out @ w["top"].T) * (kept > 0)
        patch = seen[rows, best]                                           # (windows, filters, widest x embedding)
        d_filters = np.einsum("nf,nfk->kf", d_pool, patch) * self.mask
        d_patch = d_pool[:, :, None] * w["filters"].T[None]
        places = best[:, :, None] + np.arange(max(WIDTHS))
        d_embedding = np.zeros_like(w["embedding"])
        np.add.at(d_embedding, windows[rows[:, :, None], places].reshape(-1), d_patch.reshape(-1, EMBEDDING))
        d_embedding[0] = 0
        return {"embedding": d_embedding, "filters": d_filters, "bias": d_pool.sum(axis=0), "top": kept.T @ d_out,
                "offset": d_out.sum(axis=0)}

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
        """Adam over shuffled batches, at a rate that falls to a tenth."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        epochs = max(epochs, math.ceil(200 * BATCH / len(windows)))       # at least some 200 steps on small samples
        steps, t = epochs * math.ceil(len(windows) / BATCH), 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                chosen = order[i:i + BATCH]
                rate, t = RATE * (1 - 0.9 * t / steps), t + 1
                for k, g in self.gradients(windows[chosen], labels[chosen]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9 ** t)) /
                                        (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        return self

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.weights)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, classes: list[str], data: bytes) -> ByteNet:
        net = cls(classes)
        with np.load(io.BytesIO(data)) as held:
            net.weights = {k: held[k] for k in held.files}
        return net


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts in one padded array, where each window starts, and the first window of each text.

    A window reaches ``OVERLAP`` bytes beyond its step; behind the end of a text those belong to the next one and count as padding.
    """
    counts = np.array([max(1, math.ceil(len(t) / STEP)) for t in texts], np.int64)
    first = np.r_[0, np.cumsum(counts)]
    flat = np.zeros(int(first[-1]) * STEP + WINDOW, np.uint8)
    for t, at in zip(texts, first):
        flat[at * STEP:at * STEP + len(t)] = np.frombuffer(t, np.uint8)
    return _LOWER[flat], np.arange(first[-1]) * STEP, first[:-1]


def mean_probabilities(net: ByteNet, texts: list[bytes]) -> np.ndarray:
    """Class probabilities of every text, its windows weighted by the bytes that they alone bring."""
    lengths = np.array([len(t) for t in texts], np.int64)
    flat, starts, first = windows_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.r_[first, len(starts)]))
    ends = first * STEP + lengths
    total, weight = np.zeros((len(texts), len(net.classes))), np.zeros(len(texts))
    for i in range(0, len(starts), BATCH):
        at = starts[i:i + BATCH, None] + np.arange(WINDOW)
        who = owner[i:i + BATCH]
        windows = np.where(at < ends[who, None], flat[at], 0)
        own = np.maximum(np.minimum(ends[who] - starts[i:i + BATCH], STEP), 1)
        np.add.at(total, who, net.probabilities(windows) * own[:, None])
        np.add.at(weight, who, own)
    return total / weight[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def training_sample(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``lang``, ``bytes``: at most ``sample`` windows a language of the rows that ``learn`` allows, by the smallest hashes.

    A scan counts the rows of every language; a second one keeps the share of them that is needed, before anything moves.  Languages
    with fewer texts than ``sample`` give several windows of a text.  Windows lie anywhere in a text.
    """
    text = F.col(text_col).cast("string")
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & text.rlike("\\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), text.cast("binary").alias("b"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    wanted = F.broadcast(counts.filter("lang is not null"))                # one row per class of the model
    place = F.xxhash64("b")
    share = F.pmod(place, F.lit(1 << 20)) < F.ceil(F.lit(2.0 * sample * (1 << 20)) / F.col("rows"))
    each = F.least(F.lit(MOST_PER_TEXT), F.ceil(F.lit(float(sample)) / F.col("rows"))).cast("int")
    length = F.octet_length("b")
    cut = F.pmod(F.xxhash64("b", "k"), F.greatest(length - WINDOW + 1, F.lit(1)))
    windows = (rows.join(wanted, "lang").filter(share)
               .select("lang", "b", F.explode(F.sequence(F.lit(1), F.least(each, F.ceil(length / WINDOW).cast("int")))).alias("k"))
               .select("lang", F.substring("b", (cut + 1).cast("int"), F.lit(WINDOW)).alias("bytes"), F.xxhash64("b", F.lit("order"), "k").alias("o")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "bytes"))
    return windows.withColumn("_rank", rank).filter(F.col("_rank") <= sample).select("lang", "bytes")


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteNet | None:
    """The network of the languages of ``docs``, or None without labelled text."""
    def train(group: pa.Table) -> pa.Table:
        langs, texts = group.column("lang").to_pylist(), group.column("bytes").to_pylist()
        order = sorted(range(len(langs)), key=lambda i: (langs[i], texts[i]))
        classes = sorted(set(langs))
        windows = np.zeros((len(order), WINDOW), np.uint8)
        for row, i in enumerate(order):
            windows[row, :len(texts[i])] = np.frombuffer(texts[i], np.uint8)
        labels = np.array([classes.index(langs[i]) for i in order])
        net = ByteNet(classes).train(_LOWER[windows], labels)
        return pa.table([pa.array([classes], pa.list_(pa.string())), pa.array([net.to_bytes()], pa.binary())], names=["classes", "weights"])

    found = training_sample(docs, learn, text_col, lang_col, sample).groupBy(F.lit(0).alias("all"))
    fitted = saved(found.applyInArrow(train, "classes array<string>, weights binary"), "byte-net").first()
    return ByteNet.from_bytes(fitted.classes, fitted.weights) if fitted else None


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``lang_pred``, ``score`` (probability of the language).

    Null texts, texts without a letter, and every text if there is no network are ``und`` with score 0.  Equal probabilities go to the
    language that sorts first.  Rows that repeat an id are judged one by one, other columns are ignored, an empty table gives an empty
    one.  A very long text is read whole, 64 windows at a time; it costs about four times its bytes.
    """
    classes, data = (net.classes, net.to_bytes()) if net else ([], b"")
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet.from_bytes(classes, data) if classes else None
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for start, stop in batches_of(texts, 1 << 20):
                some = [i for i in range(start, stop) if own and texts[i] and has_letter(texts[i])]
                if some:
                    p = mean_probabilities(own, [texts[i].encode("utf-8") for i in some])
                    best = p.argmax(axis=1)
                    score[some] = np.clip(p[np.arange(len(some)), best], 0, 1)
                    for i, c in zip(some, best):
                        pred[i] = classes[c]
            yield pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(score)], schema=schema)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "id long, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """A third of the ids, by crc32; a null id counts as no digits, so it is not held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred``, ``score``: a network fitted on what is not held out judges every text."""
    found = predict(docs, fit(docs, ~held_out(id_col), text_col, lang_col, sample), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
