"""Toxicity scores from compression distance with zstandard dictionaries.

Learning, on a bounded sample of the labelled rows (parameters: at most ``per_class`` texts of each
label, of each at most ``fit_bytes`` bytes, as windows drawn evenly from all over it; texts of any
length are eligible):

* a base dictionary is trained on windows of ordinary texts; it stands before both others, so that
  what all texts have in common costs them the same;
* an ordinary and a toxic dictionary are trained on windows of texts of their label, both of the
  same size and with the same parameters. Most windows of a toxic text are ordinary, so a second
  pass trains each of them again on the windows that matter: of toxic texts those that a toxic
  dictionary of other texts saves most in, of ordinary texts those that it wrongly saves most in
  (and the ones of the first pass), so that the ordinary one knows what both labels share;
* there are ``PAIRS`` such pairs, from different shuffles: what one dictionary holds by chance, the
  others do not.

Scoring cuts every whole text into windows of about ``WINDOW`` bytes that end between words and
compresses each with all dictionaries. Of a window three differences are taken (mean ordinary length
less mean toxic length, least ordinary less mean toxic, least ordinary less greatest toxic), and of
these over the text the greatest, the sum of squares of the positive ones, and that by the root of the
number of windows. A logistic function turns them into a probability. It is calibrated on whole
texts that the dictionaries were not trained on (half of the sample), and placed so that 0.7 is the
threshold that finds most toxic texts there while at most ``false_share`` of the ordinary ones pass it.

Defined results: a null or empty text has no windows and gets the score of such texts. If the sample
lacks a class, every score is that of the only class (0 without labels). The labels table may hold
repeated ids (toxic if any row says so), nulls (left out) and other columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, sample_bounded, small_batches
from .textbytes import LOWER, NOT_SPACE, column_bytes, release

LEVEL = 9
WINDOW = 64
THRESHOLD = 0.7
PAIRS = 3
BASE_BYTES, PAIR_BYTES = 32 << 10, 4 << 10
SURE, ENOUGH = 0.02, 256  # share of windows that the second pass trains on, and a number that few texts give more than this share of
FEATURES = 10


@dataclass
class Model:
    base: bytes = b""
    pairs: list[tuple[bytes, bytes]] = field(default_factory=list)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float | None = None


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of consecutive windows of every text, cut at the last gap between words within a window's second half; the next begins with the cut."""
    gaps = np.flatnonzero(~NOT_SPACE[data])
    length = np.diff(offsets)
    pieces = -(-length // size)
    text = np.repeat(np.arange(len(length)), pieces)
    k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][text] + k * size
    if len(gaps):  # move every inner cut back to a gap that is near
        at = np.searchsorted(gaps, start, side="right") - 1
        gap = gaps[np.maximum(at, 0)]
        start = np.where((k > 0) & (at >= 0) & (start - gap < size // 2), gap, start)
    end = np.append(start[1:], offsets[-1] if len(offsets) else 0)
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    end[last] = offsets[1:][text[last]]
    return start, end, text


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def lengths(with_: zstandard.ZstdCompressor, pieces: list[bytes]) -> np.ndarray:
    compress = with_.compress
    return np.fromiter((len(compress(x)) for x in pieces), np.float64, len(pieces))


class Scorer:
    """The compressors, made once per process."""

    def __init__(self, model: Model):
        self.model = model
        self.ordinary, self.toxic = ([compressor(model.base + x) for x in side] for side in zip(*model.pairs, strict=True)) if model.pairs else ([], [])

    def _of_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start, end, text = windows(data, offsets)
        raw = LOWER[data].tobytes()
        pieces = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        n = len(offsets) - 1
        count = np.bincount(text, minlength=n)
        out = [np.log1p(count)]
        ordinary, toxic = (np.stack([lengths(c, pieces) for c in side]) for side in (self.ordinary, self.toxic))
        for saved in (ordinary.mean(axis=0) - toxic.mean(axis=0), ordinary.min(axis=0) - toxic.mean(axis=0), ordinary.min(axis=0) - toxic.max(axis=0)):
            most = np.full(n, -float(WINDOW))
            np.maximum.at(most, text, saved)
            squares = np.bincount(text, np.maximum(saved, 0) ** 2, n)
            out += [np.where(count > 0, most, 0), np.log1p(squares), squares / np.sqrt(count + 3)]
        return np.stack(out, axis=1)

    def features(self, column) -> np.ndarray:
        data, offsets = column_bytes(column)
        n = len(offsets) - 1
        out = np.zeros((n, FEATURES))
        at = 0
        while at < n:  # texts of about 1 MB at a time, so that the windows held are few
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
            out[at:to] = self._of_texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
        release()
        return out

    def probability(self, column) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(column), self.model.constant)
        x = (self.features(column) - self.model.mean) / self.model.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights[:-1] + self.model.weights[-1], -30, 30)))


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """The content of a trained dictionary, filled up to its size; plain sample text where there is too little to train on."""
    try:
        content = zstandard.train_dictionary(size, samples, k=k, d=8, f=20, accel=1, steps=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        content = b"".join(samples)[-size:]
    return content.rjust(size, b"\0")


def _pair(base: bytes, ordinary: list[list[bytes]], toxic: list[list[bytes]], seed: int) -> tuple[bytes, bytes]:
    """An ordinary and a toxic dictionary from windows of texts, in two passes; each half of the texts is judged by dictionaries of the other half."""
    rng = np.random.default_rng(seed)
    halves = lambda texts, order: [[w for i in order[f::2] for w in texts[i]] for f in (0, 1)]
    split = [halves(x, rng.permutation(len(x))) for x in (ordinary, toxic)]
    plain = compressor(base)
    rate = lambda ws: lengths(plain, ws) / np.maximum([len(w) for w in ws], 16) if ws else np.zeros(0)
    rates = [[rate(ws) for ws in side] for side in split]
    rare = np.quantile(rates[0][0], 0.9) if len(rates[0][0]) else 0.0
    # first pass: windows that the base compresses badly
    first = [[[w for w, r in zip(ws, rs, strict=True) if r >= rare] for ws, rs in zip(side, of, strict=True)] for side, of in zip(split, rates, strict=True)]
    second: list[list[bytes]] = [[], []]
    for f in (0, 1):
        both = [compressor(base + _trained(side[1 - f], PAIR_BYTES, 12)) for side in first]
        for side in (0, 1):
            ws = split[side][f]
            saved = lengths(both[0], ws) - lengths(both[1], ws)
            share = min(0.25, max(SURE, ENOUGH / max(len(ws), 1)))
            least = np.quantile(saved, 1 - share) if len(saved) else 0.0
            second[side] += [w for w, s in zip(ws, saved, strict=True) if s >= least]
        second[0] += first[0][f]
    return _trained(second[0], PAIR_BYTES, 12), _trained(second[1], PAIR_BYTES, 12)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = x1.T @ (x1 * (weight * p * (1 - p) + 1e-6)[:, None]) / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x1.T @ (weight * (p - y)) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_windows(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Model:
    """The dictionaries, from the windows of each text."""
    base = _trained([b"".join(t[i : i + 32]) for t in ordinary[::2] for i in range(0, len(t), 32)], BASE_BYTES, 64)
    rest = ordinary[1::2] or ordinary
    return Model(base, [_pair(base, rest, toxic, seed) for seed in range(PAIRS)])


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, false_share: float = 0.015) -> None:
    """The logistic function from features of texts that the dictionaries have not seen."""
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights = _logistic((x - model.mean) / model.scale, y, ridge=max(1e-2, 5 / len(y)))  # few texts: smaller weights
    margin = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
    order = np.unique(margin)
    cuts = np.append((order[1:] + order[:-1]) / 2, order[-1] + 1)
    plain, marked = margin[y == 0], margin[y == 1]
    cut = next(c for c in cuts if (plain >= c).mean() <= false_share)
    if marked.min() > plain.max():  # nothing in between: the middle of the gap
        cut = (marked.min() + plain.max()) / 2
    elif len(plain) * false_share < 1:  # so few texts cannot show this share: at least where a normal distribution has 0.015 beyond it
        cut = max(cut, plain.mean() + 2.17 * plain.std())
    model.weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut


def excerpt(column, most: int) -> pa.Array:
    """Windows of each text, lower-cased, evenly from all over it, of about `most` bytes in all."""
    data, offsets = column_bytes(column)
    start, end, text = windows(data, offsets)
    raw = LOWER[data].tobytes()
    first = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        limit = max(1, most // WINDOW)
        at = range(a, b) if b - a <= limit else (a + np.arange(limit) * (b - a) // limit).tolist()
        out.append([raw[start[i] : end[i]] for i in at])
    release()
    return pa.array(out, pa.list_(pa.binary()))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 2500, fit_bytes: int = 1 << 14) -> Model:
    """Learn from a bounded sample of the labelled rows of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna().groupBy("key").agg(F.max("label").alias("label"))
    ids = docs.where(F.octet_length(F.col(text)) > 0).select(F.col(key).alias("key"))
    known = marked.join(ids.distinct(), "key").persist()
    try:
        picked = [sample_bounded(known.where(F.col("label") == k), F.col("key"), per_class, 7).collect() for k in (1, 0)]
    finally:
        known.unpersist()
    if not all(picked):
        return Model(constant=1.0 if picked[0] else 0.0)
    # every second one, in a fixed order, is kept apart for calibration
    order = lambda rows: sorted((r.key for r in rows), key=lambda x: (x * 2654435761 % (1 << 32), x))
    fold = {x: (k, int(i % 2) if len(rows) > 1 else 2) for k, rows in zip((1, 0), picked, strict=True) for i, x in enumerate(order(rows))}
    chosen = F.broadcast(spark.createDataFrame([(x, k, f) for x, (k, f) in fold.items()], "key long, label int, fold int"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") > 0).join(chosen, "key")

    @F.arrow_udf("array<binary>")
    def drawn(column: pa.Array) -> pa.Array:
        return excerpt(column, fit_bytes)

    # rows that repeat an id count once, by the least hash of their text
    texts = rows.where("fold <> 1").select("key", "label", F.xxhash64("text").alias("h"), drawn("text").alias("w")).groupBy("key", "label").agg(F.min_by("w", "h").alias("w")).collect()
    texts = sorted(texts, key=lambda r: r.key)
    model = fit_windows(*([[bytes(w) for w in r.w] for r in texts if r.label == k] for k in (1, 0)))
    shared = spark.sparkContext.broadcast(model)
    held: list[Scorer] = []

    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(shared.value))
        x = held[0].features(column)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))

    apart = rows.where("fold <> 0").select("key", "label", F.xxhash64("text").alias("h"), features("text").alias("x")).groupBy("key", "label").agg(F.min_by("x", "h").alias("x")).collect()
    apart = sorted(apart, key=lambda r: r.key)
    calibrate(model, np.array([r.x for r in apart]), np.array([float(r.label) for r in apart]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, the probability that the text is toxic; and that column's name."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    @F.arrow_udf("double")
    def toxic(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(shared.value))
        return pa.array(held[0].probability(column), pa.float64())

    name = fresh(docs, "toxic_score")
    return docs.withColumn(name, toxic(F.col(text))), name
