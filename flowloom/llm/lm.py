"""Language-model scoring with a weighted backoff automaton over words.

The model is a bigram model with backoff, learnt from all training texts. Its automaton has a state
for every word seen in training (and one for the start of a text) and a root. From the state of u

* an arc on w, if u w was seen, with log10 of (1 - b) c(uw) / c(u) + b p(w), leading to the state of w;
* a failure arc to the root with log10 b, taken if no arc matches;

and from the root an arc on every known word with log10 p(w), and one on any other word with the
mass kept for unknown ones, which leads to the root. b depends on u by the power of two that c(u)
lies in. The probabilities of a state sum to one.

p is the absolutely discounted unigram model: p(w) = (c(w) - D) / N, the mass D V / N is that of all
unknown words, D = n1 / (n1 + 2 n2). The backoff weights b are those with the greatest likelihood
of the training texts when each text's own counts are left out (deleted interpolation).

Words and pairs are known by 64-bit hashes (gather.py says how rarely two share one).

The automaton grows with the corpus and is never in one place. A block of texts gets the counts of
the arcs that its own texts can take (see gather.py), builds that part of the automaton, and passes
each text through it once from left to right. A matched arc's target depends on the word alone, so
the states of all positions are known at once and the traversal is done for all texts of a block
together.

Tokens are maximal runs of other bytes than space, tab, newline, vertical tab, form feed and
carriage return, A-Z lower-cased, then one end of text. Defined results: a null text is an empty
one, which is the end alone; without training texts every token is unknown with probability 1;
repeated rows are texts of their own; a null id counts as the empty text for the hold-out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gather import Layout, answers, blocked, sent, summary, totals_of
from .textbytes import NOT_SPACE, column_bytes, mix, mix_int, release, words

END, START = mix_int(1), mix_int(2)
WORD, PAIR = 0, 1
BINS, RATIOS, LOWEST, STEP = 48, 128, -16.0, 0.5
OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


class Block:
    """The tokens of a block's texts, and its distinct words and pairs with their training counts in it."""

    def __init__(self, table: pa.Table):
        data, offsets = column_bytes(table.column("text"))
        _, _, h, first = words(data, offsets, NOT_SPACE)
        n = len(offsets) - 1
        self.train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
        count = np.diff(first)
        self.text = np.repeat(np.arange(n), count + 1)
        self.last = np.cumsum(count + 1) - 1
        token = np.full(len(self.text), END, np.uint64)
        inner = np.ones(len(token), bool)
        inner[self.last] = False
        token[inner] = h
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.last - count] = START
        weight = self.train[self.text].astype(np.int64)
        self.word, self.token, self.word_n = self._distinct(mix(token), weight)
        self.pair, self.token_pair, self.pair_n = self._distinct(mix(before * _ODD + token), weight)
        # the state before each token: the word before it, or the start
        self.state = np.empty(len(token), np.int64)
        self.state[1:] = self.token[:-1]
        self.state[self.last - count] = -1

    @staticmethod
    def _distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unique, inverse = np.unique(keys, return_inverse=True)
        return unique, inverse, np.bincount(inverse, weight, len(unique)).astype(np.int64)

    def parts(self):
        return [(WORD, self.word, self.word_n), (PAIR, self.pair, self.pair_n)]


class Counts:
    """Totals over the training texts for a block's words and pairs."""

    def __init__(self, block: Block, answer: pa.Table, train_texts: int):
        self.word = totals_of(answer, WORD, len(block.word))
        self.pair = totals_of(answer, PAIR, len(block.pair))
        self.at_state = np.append(self.word, train_texts)[block.state]  # -1 is the start
        self.at_pair = self.pair[block.token_pair]
        self.at_word = self.word[block.token]


def discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def _unigram(c: np.ndarray, total: int, distinct: int, d: float) -> np.ndarray:
    if not total:
        return np.ones(len(c))
    return np.where(c > 0, (c - d) / total, d * distinct / total)


def _bin(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BINS - 1)


def left_out_ratios(block: Block, counts: Counts, total: int, distinct: int, d: float) -> np.ndarray:
    """Histogram over training tokens, by size of the state's count, of bigram by unigram probability, without the text's own counts."""
    own = lambda key: _own_counts(block.text, key)
    rows = np.flatnonzero(block.train[block.text])
    state = counts.at_state - own(block.state + 1)
    pair = counts.at_pair - own(block.token_pair)
    word = counts.at_word - own(block.token)
    rows = rows[state[rows] > 0]
    state, pair, word = state[rows], pair[rows], word[rows]
    ratio = pair / state / _unigram(np.maximum(word, 0), total, distinct, d)
    where = np.zeros(len(rows), np.int64)
    some = ratio > 0
    where[some] = np.clip(np.rint((np.log2(ratio[some]) - LOWEST) / STEP), 0, RATIOS - 2).astype(np.int64) + 1
    return np.bincount(_bin(state) * RATIOS + where, minlength=BINS * RATIOS)


def _own_counts(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    joint = text.astype(np.int64) * (int(key.max()) + 1 if len(key) else 1) + key
    _, inverse, n = np.unique(joint, return_inverse=True, return_counts=True)
    return n[inverse]


def backoff_weights(histogram: np.ndarray, rounds: int = 100) -> np.ndarray:
    """For each bin the weight b that makes sum of log((1 - b) ratio + b) greatest. Bins without tokens take their neighbour's."""
    h = np.asarray(histogram, float).reshape(BINS, RATIOS)
    ratio = np.concatenate([[0.0], 2.0 ** (LOWEST + STEP * np.arange(RATIOS - 1))])
    out = np.full(BINS, np.nan)
    for i in np.flatnonzero(h.sum(axis=1) >= 1):
        b = 0.5
        for _ in range(rounds):
            b = float((h[i] * b / ((1 - b) * ratio + b)).sum() / h[i].sum())
        out[i] = min(max(b, 1e-4), 1 - 1e-6)
    known = np.flatnonzero(~np.isnan(out))
    return np.full(BINS, 0.9) if not len(known) else np.interp(np.arange(BINS), known, out[known])


def traverse(block: Block, counts: Counts, total: int, distinct: int, d: float, backoff: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    p = _unigram(counts.at_word, total, distinct, d)
    b = backoff[_bin(counts.at_state)]
    state = np.maximum(counts.at_state, 1)
    arc = np.where(counts.at_state > 0, (1 - b) * counts.at_pair / state + b * p, p)
    return np.bincount(block.text, np.log10(arc), len(block.train))


def scored(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: OUT. `train` says which rows the model is learnt from."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    train_texts = rows.where("train").count()
    layout = Layout.of(rows, "text", 2)
    texts = blocked(rows, layout, F.col("doc_id"), F.col("text"))
    pieces = sent(texts, layout, lambda table: Block(table).parts())
    facts = summary(pieces, layout, WORD).select(F.struct("total", "distinct", "once", "twice").alias("facts"))
    replies = answers(pieces, layout).withColumn("facts", facts.scalar())

    def known(right: pa.Table):
        f = right.column("facts")[0].as_py()
        return f["total"], f["distinct"], discount(f["once"], f["twice"])

    def count_ratios(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        h = left_out_ratios(block, Counts(block, right, train_texts), *known(right))
        at = np.flatnonzero(h)
        release()
        return pa.table({"at": pa.array(at, pa.int32()), "n": pa.array(h[at], pa.int64())})

    def join(right: DataFrame):
        return texts.groupBy("block").cogroup(right.groupBy("block"))

    ratios = join(replies).applyInArrow(count_ratios, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    histogram = ratios.agg(F.collect_list(F.struct("at", "n")).alias("ratios"))  # at most BINS * RATIOS entries

    @F.arrow_udf("array<double>")
    def fitted(column: pa.Array) -> pa.Array:
        out = []
        for entries in column.to_pylist():
            h = np.zeros(BINS * RATIOS)
            for x in entries or []:
                h[x["at"]] = x["n"]
            out.append(backoff_weights(h))
        return pa.array(out, pa.list_(pa.float64()))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        counts = Counts(block, right, train_texts)
        total, distinct, d = known(right)
        backoff = np.array(right.column("backoff")[0].as_py())
        n = len(block.train)
        release()
        base = np.log10((counts.at_word + 1) / (total + distinct + 1))
        return pa.table({
            "doc_id": left.column("doc_id"), "n_tokens": pa.array(np.bincount(block.text, minlength=n), pa.int64()), "n_known": pa.array(np.bincount(block.text, counts.at_word > 0, n).astype(np.int64), pa.int64()),
            "train_tokens": pa.array(np.full(n, total), pa.int64()), "base_score": pa.array(np.bincount(block.text, base, n)), "score": pa.array(traverse(block, counts, total, distinct, d, backoff)),
        })

    backoff = histogram.select(fitted("ratios").alias("backoff"))
    return join(replies.withColumn("backoff", backoff.scalar())).applyInArrow(score, OUT)
