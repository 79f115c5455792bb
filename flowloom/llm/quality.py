"""Quality classification by co-training of two views.

The text view has shape statistics of the whole text (letter case, symbols, digits, word lengths,
repeated words, line lengths); the metadata view has what the page record says without its text:
the declared length, language and source. Each view has its own logistic classifier. Starting from
the labelled sample, in every round each classifier marks the unlabelled rows it is surest of, in
the proportion of the classes, and these join the other's training set. Both views are then
calibrated on labelled rows kept apart, and a logistic function of the two calibrated log-odds
scores all documents.

Only fitting uses samples: at most ``labelled`` labelled and ``pool`` unlabelled rows, both
parameters. All documents are scored, each from its whole text and metadata.

Defined results: a null or empty text has the statistics of no characters; null metadata counts as
a category of its own; languages and sources that the sample lacks count as average. Without labels
of both classes the score is the share of good labels (1 with none). Repeated labels of a document
are averaged, labels of unknown documents ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, sample_bounded, small_batches
from .textbytes import NOT_SPACE, column_bytes, mix, release, words

TEXT_FEATURES = 14
THRESHOLD = 0.25


def _tables() -> list[np.ndarray]:
    b = np.arange(256)
    upper = (b >= 65) & (b <= 90)
    lower = (b >= 97) & (b <= 122)
    digit = (b >= 48) & (b <= 57)
    space = ~NOT_SPACE
    newline = b == 10
    stop = np.isin(b, [ord(c) for c in ".,;:?'\"-()"])
    symbol = (b >= 33) & (b < 127) & ~upper & ~lower & ~digit & ~stop
    return [upper, lower, digit, space, newline, stop, symbol, b >= 128]


_TABLES = _tables()


def text_features(column) -> np.ndarray:
    data, offsets = column_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, TEXT_FEATURES))
    at = 0
    while at < n:  # texts of about half a MB at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 19), side="right")) - 1)
        piece, edges = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        out[at:to] = _features(piece, edges)
        at = to
    release()
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    kinds = np.zeros(256, np.int32)  # bits: every byte is of one or two kinds
    for i, t in enumerate(_TABLES):
        kinds[t] |= 1 << i
    patterns, code = np.unique(kinds, return_inverse=True)
    counts = np.bincount(owner * np.int64(len(patterns)) + code[data], minlength=n * len(patterns)).reshape(n, -1)
    upper, lower, digit, space, newline, stop, symbol, wide = (counts[:, (patterns >> i & 1) > 0].sum(axis=1) for i in range(len(_TABLES)))
    start, end, h, first = words(data, offsets, NOT_SPACE)
    k = np.diff(first)
    text = np.repeat(np.arange(n), k)
    length = (end - start).astype(float)
    mean = np.bincount(text, length, n) / np.maximum(k, 1)
    distinct = np.bincount(text[np.unique(mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]], minlength=n)
    again = np.zeros(n)
    if len(h) > 1:
        again = np.bincount(text[1:], (h[1:] == h[:-1]) & (text[1:] == text[:-1]), n)
    one = np.maximum(size, 1)
    share = lambda x: x / one
    per_word = lambda x: x / np.maximum(k, 1)
    return np.stack([
        np.log1p(size), upper / np.maximum(upper + lower, 1), share(digit), share(space), share(newline) * 20, share(stop), share(symbol), share(wide),
        np.minimum(mean, 40) / 10, np.minimum(per_word(symbol), 4), distinct / np.maximum(k, 1) ** 0.75, per_word(again), per_word(stop), np.minimum(size / (newline + 1), 2000) / 1000,
    ], axis=1)


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1]) + self.shift


@dataclass
class Model:
    text: Linear | None
    page: Linear | None
    rates: dict
    blend: np.ndarray
    prior: float


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) / len(y) + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) / len(y) + penalty * w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> Linear:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return Linear(mean, scale, _newton(np.clip((x - mean) / scale, -6, 6), y, weight, ridge))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cotrain(xt: np.ndarray, xp: np.ndarray, y: np.ndarray, ut: np.ndarray, up: np.ndarray, rounds: int = 5, share: float = 0.04, sure: float = 0.9) -> tuple[Linear, Linear, np.ndarray]:
    """Both views and the blend of their log-odds. xt, xp, y: labelled rows; ut, up: the unlabelled pool, same rows in both views."""
    calibration = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[calibration])) < 2 or len(np.unique(y[~calibration])) < 2:
        calibration = np.zeros(len(y), bool)
    fit = ~calibration
    views, pools = (xt, xp), (ut, up)
    own = [(v[fit], y[fit], np.ones(fit.sum())) for v in views]
    left = np.ones(len(ut), bool)
    good = y.mean()
    for _ in range(rounds):
        models = [_linear(*t) for t in own]
        if not left.any():
            break
        taken = np.zeros(len(ut), bool)
        for giver in (0, 1):  # each view marks rows for the other
            p = _sigmoid(models[giver].logit(pools[giver]))
            for value, q in ((1.0, p), (0.0, 1 - p)):
                quota = max(1, int(share * len(ut) * (good if value else 1 - good)))
                open_rows = np.flatnonzero(left & (q >= sure))
                best = open_rows[np.argsort(-q[open_rows], kind="stable")[:quota]]
                taken[best] = True
                x, t, w = own[1 - giver]
                own[1 - giver] = (np.vstack([x, pools[1 - giver][best]]), np.append(t, np.full(len(best), value)), np.append(w, q[best] * 0.5))
        left &= ~taken
    models = [_linear(*t) for t in own]
    rows = calibration if calibration.any() else fit
    for m, v in zip(models, views, strict=True):  # Platt scaling on labelled rows kept apart
        a, b = _newton(m.logit(v[rows])[:, None], y[rows], np.ones(rows.sum()), 1e-3)
        m.slope, m.shift = max(float(a), 0.0), float(b)
    both = np.stack([m.logit(v) for m, v in zip(models, views, strict=True)], axis=1)
    blend = _newton(both[rows], y[rows], np.ones(rows.sum()), 1e-3)
    return models[0], models[1], blend


def _page_table(rates: dict, lang, source, n_chars) -> np.ndarray:
    def rate(kind, values):
        known, base = rates.get(kind, {}), rates.get("", 0.0)
        return [known.get(v, base) for v in values]

    length = np.array([-1.0 if v is None else float(max(v, 0)) for v in n_chars])
    return np.stack([np.log1p(np.maximum(length, 0)), (length < 0).astype(float), np.log1p(np.maximum(length, 0)) ** 2 / 10, np.array(rate("lang", lang), float), np.array(rate("source", source), float)], axis=1)


def _rates(y: np.ndarray, columns: dict[str, list], strength: float = 50.0, most: int = 1000) -> dict:
    """Smoothed log-odds of the good label by category; the rarest categories beyond `most` count as average."""
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    out: dict = {"": float(np.log(base / (1 - base)))}
    for kind, values in columns.items():
        held: dict = {}
        for v, t in zip(values, y, strict=True):
            n, s = held.get(v, (0, 0.0))
            held[v] = (n + 1, s + t)
        smooth = {v: (s + strength * base) / (n + strength) for v, (n, s) in sorted(held.items(), key=lambda x: (-x[1][0], str(x[0])))[:most]}
        out[kind] = {v: float(np.log(p / (1 - p))) for v, p in smooth.items()}
    return out


def _with_features(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        x = text_features(column)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TEXT_FEATURES, pa.int32()), pa.array(x.ravel()))

    return docs.select(*names, features(F.col(text)).alias("x"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", page: tuple[str, str, str] = ("lang", "source", "n_chars"), labelled: int = 12_000, pool: int = 12_000) -> Model:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(n) for c, n in zip(page, ("lang", "source", "n_chars"), strict=True)))
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).dropna().groupBy("key").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    chosen = sample_bounded(marked, F.col("key"), labelled, 5)
    names = ["key", "lang", "source", "n_chars"]
    known = rows.join(F.broadcast(chosen), "key").select(*names, "y", "text")
    unknown = sample_bounded(rows.select("key").distinct(), F.col("key"), pool, 11)
    unknown = rows.join(F.broadcast(unknown), "key").join(F.broadcast(chosen.select("key")), "key", "left_anti")
    good = lambda df, cols: _with_features(df, "text", cols).orderBy(F.xxhash64("key"), "key", F.hash("x")).limit(2 * max(labelled, pool)).toPandas()
    a = good(known, [*names, "y"])
    y = a["y"].to_numpy(float)
    if len(np.unique(y)) < 2:
        return Model(None, None, {}, np.zeros(3), float(y.mean()) if len(y) else 1.0)
    b = good(unknown, names)
    plain = lambda df, c: [None if v is None or v != v else v for v in df[c].tolist()]
    rates = _rates(y, {"lang": plain(a, "lang"), "source": plain(a, "source")})
    matrix = lambda df: np.array(df["x"].tolist(), float).reshape(len(df), TEXT_FEATURES)
    meta = lambda df: _page_table(rates, plain(df, "lang"), plain(df, "source"), plain(df, "n_chars"))
    in_text, in_page, blend = cotrain(matrix(a), meta(a), y, matrix(b), meta(b))
    return Model(in_text, in_page, rates, blend, float(y.mean()))


def score(docs: DataFrame, model: Model, text: str = "text", page: tuple[str, str, str] = ("lang", "source", "n_chars")) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of p_text, p_page and score; and that column's name."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<p_text:double,p_page:double,score:double>")
    def judge(column: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        m = shared.value
        if m.text is None:
            out = [np.full(len(column), m.prior)] * 3
        else:
            t = m.text.logit(text_features(column))
            p = m.page.logit(_page_table(m.rates, lang.to_pylist(), source.to_pylist(), n_chars.to_pylist()))
            out = [_sigmoid(t), _sigmoid(p), _sigmoid(t * m.blend[0] + p * m.blend[1] + m.blend[2])]
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in out], ["p_text", "p_page", "score"])

    name = fresh(docs, "judged")
    return docs.withColumn(name, judge(*(F.col(c) for c in (text, *page)))), name
