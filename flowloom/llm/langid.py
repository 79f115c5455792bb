"""Language identification with bit-sliced Bloom filters over byte 4-grams.

Learning counts the 4-grams of every training text by language (one pre-aggregated shuffle),
keeps for a language those whose rate in it is at least ``min_rate`` and at least ``share`` of the
best rate in any language, and writes them to one Bloom filter per language. The filters share
their hash positions and are stored bit-sliced: a slot is a byte whose bits are eight languages
(more languages: more planes), so one lookup answers for all languages at once. A text's 4-grams
give a bitmask each; the popcount per language, corrected by that filter's false-positive rate,
decides. ``min_rate`` bounds the filters: at most 1 / min_rate 4-grams of a language qualify,
whatever the size of the corpus.

Defined results: a null text or one without a letter gives `und` and 0; one with letters but no
4-gram known gives the language with most training bytes and 0; ties go to the language with more
training text. Without any training text all predictions are `und`. Any other columns of the
input, whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches
from .textbytes import LOWER, column_bytes, release

HASHES = 4
SEGMENT = 1 << 18
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    planes: list[np.ndarray]
    false_rate: np.ndarray


_FOLD = np.where(((LOWER >= 97) & (LOWER <= 122)) | (np.arange(256) >= 128), LOWER, 32).astype(np.uint8)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(4-gram codes, index of the text) piece by piece; grams with two or more non-letters are left out."""
    for a in range(0, max(len(data) - 3, 0), SEGMENT):
        piece = _FOLD[data[a : a + SEGMENT + 3]]
        n = len(piece) - 3
        if n <= 0:
            return
        gap = (piece == 32).view(np.uint8)
        good = (gap[:n] + gap[1 : n + 1] + gap[2 : n + 2] + gap[3:]) <= 1
        lo, hi = np.searchsorted(offsets, [a, a + n + 3])
        edges = offsets[lo:hi] - a
        for back in (1, 2, 3):  # a gram that begins before an edge and ends after it
            at = edges - back
            good[at[(at >= 0) & (at < n)]] = False
        at = np.flatnonzero(good)
        wide = piece.astype(np.uint32)
        code = wide[:n] | wide[1 : n + 1] << 8 | wide[2 : n + 2] << 16 | wide[3:] << 24
        yield code[at], np.searchsorted(offsets, at + a, side="right") - 1


def _slots(code: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(_MULTIPLIERS[k])) >> np.uint64(64 - bits)


def _count(batches):
    """Counts of each language's 4-grams, summed over the partition."""
    held: dict[str, list] = {}

    def merged(parts):
        codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        unique, inverse = np.unique(codes, return_inverse=True)
        return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64)

    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        names = batch.column("lang").to_pylist()
        order = {x: i for i, x in enumerate(dict.fromkeys(names))}
        lang = np.array([order[x] for x in names], np.uint64)
        for code, text in grams(data, offsets):
            key, n = np.unique(lang[text] << np.uint64(32) | code.astype(np.uint64), return_counts=True)
            cut = np.searchsorted(key, np.arange(len(order) + 1, dtype=np.uint64) << np.uint64(32))
            for name, i in order.items():
                if cut[i] < cut[i + 1]:
                    parts = held.setdefault(name, [])
                    parts.append((key[cut[i] : cut[i + 1]] & np.uint64(0xFFFFFFFF), n[cut[i] : cut[i + 1]]))
                    if len(parts) >= 16:
                        held[name] = [merged(parts)]
    release()
    for name, parts in held.items():
        codes, n = merged(parts)
        for a in range(0, len(codes), 1 << 16):
            b = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes[b])), pa.array(codes[b].astype(np.int64)), pa.array(n[b])], ["lang", "gram", "n"])


def fit(train: DataFrame, text: str = "text", lang: str = "lang", min_rate: float = 1e-5, share: float = 0.2) -> Model:
    """Learn from all rows of `train` that have both text and language."""
    small_batches(train.sparkSession)
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = sorted(((r.total, r.lang) for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()), key=lambda x: (-x[0], x[1]))
        if not totals:
            return Model([], [], np.zeros(0))
        spark = train.sparkSession
        by_lang = spark.createDataFrame([(name, i, float(total)) for i, (total, name) in enumerate(totals)], "lang string, i int, total double")
        rated = counts.join(F.broadcast(by_lang), "lang").select("gram", "i", "n", (F.col("n") / F.col("total")).alias("rate")).where((F.col("rate") >= min_rate) & (F.col("n") >= 2))
        # one row for each gram: its languages are few, so the best rate is found without a window
        kept = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("i", "rate")).alias("by"))
        kept = kept.select("gram", F.transform(F.filter("by", lambda x: x["rate"] >= share * F.col("best")), lambda x: x["i"]).alias("i"))
        got = kept.select("gram", F.explode("i").alias("i")).toPandas()
    finally:
        counts.unpersist()
    gram, which = got["gram"].to_numpy(np.uint64), got["i"].to_numpy(np.int64)
    most = int(np.bincount(which, minlength=len(totals)).max()) if len(which) else 0
    bits = max(12, int(np.ceil(np.log2(max(1, 12 * most)))))
    planes = [np.zeros(1 << bits, np.uint8) for _ in range((len(totals) + 7) // 8)]
    for i in range(len(totals)):
        code = gram[which == i]
        for k in range(HASHES):
            planes[i // 8][_slots(code, k, bits)] |= np.uint8(1 << (i % 8))
    false_rate = np.array([np.mean(planes[i // 8] >> (i % 8) & 1) ** HASHES for i in range(len(totals))])
    return Model([name for _, name in totals], planes, false_rate)


def predict_batch(model: Model, column) -> tuple[list[str], np.ndarray]:
    data, offsets = column_bytes(column)
    n = len(offsets) - 1
    hits, seen = np.zeros((n, len(model.langs))), np.zeros(n)
    popcount = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(float)
    bits = int(np.log2(len(model.planes[0]))) if model.planes else 0
    for code, text in grams(data, offsets) if model.planes else ():
        lo = int(text[0]) if len(text) else 0
        local, width = text - lo, (int(text[-1]) - lo + 1) if len(text) else 0
        seen[lo : lo + width] += np.bincount(local, minlength=width)
        slots = [_slots(code, k, bits) for k in range(HASHES)]
        for p, plane in enumerate(model.planes):
            mask = plane[slots[0]]
            for s in slots[1:]:
                mask &= plane[s]
            table = np.bincount(local * 256 + mask, minlength=width * 256).reshape(width, 256) @ popcount
            span = slice(p * 8, min(p * 8 + 8, len(model.langs)))
            hits[lo : lo + width, span] += table[:, : span.stop - span.start]
    false = model.false_rate[None, :]
    corrected = np.maximum(0, (hits - seen[:, None] * false) / np.maximum(1e-9, 1 - false))
    letters = _has_letter(data, offsets)
    if not model.langs:
        return [UNDETERMINED] * n, np.zeros(n)
    best = corrected.argmax(axis=1)
    score = np.clip(corrected[np.arange(n), best] / np.maximum(seen, 1), 0, 1)
    return [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    wide = data >= 128
    letter = (LOWER[data] >= 97) & (LOWER[data] <= 122)
    found = np.zeros(len(offsets) - 1, bool)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        found[i] = letter[a:b].any() or (wide[a:b].any() and any(c.isalpha() for c in bytes(data[a:b]).decode("utf-8", "ignore")))
    return found


def predictor(spark, model: Model):
    """A function from a text column to a struct of lang_pred and score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        lang, score = predict_batch(shared.value, column)
        release()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", **options) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of lang_pred and score; and that column's name."""
    name = fresh(docs, "language")
    predict = predictor(docs.sparkSession, fit(train, text, lang, **options))
    return docs.withColumn(name, predict(F.col(text))), name


def accepted(prediction: Column, least: float) -> Column:
    """A determined language with at least the share `least` of its 4-grams known."""
    return (prediction["lang_pred"] != UNDETERMINED) & (prediction["score"] >= least)
