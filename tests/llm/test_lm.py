import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import gather, lm
from flowloom.llm.common import crc_mod
from flowloom.llm.queries import QUERIES


def tokens(text):
    raw = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", raw), None]


def brute(texts, train, backoff=None):
    """Scores by walking the automaton word by word; backoff weights as given by the operator's own estimate."""
    words, pairs, states = Counter(), Counter(), Counter()
    for t, learn in zip(texts, train, strict=True):
        if learn:
            seq = tokens(t)
            words.update(seq)
            pairs.update(zip(["<s>", *seq], seq, strict=False))
            states.update(["<s>", *seq[:-1]])
    total, distinct = sum(words.values()), len(words)
    once, twice = (sum(v == k for v in words.values()) for k in (1, 2))
    d = lm.discount(once, twice)
    p = lambda w: (words[w] - d) / total if words[w] else d * distinct / total if total else 1.0
    histogram = np.zeros(lm.BINS * lm.RATIOS)
    for t, learn in zip(texts, train, strict=True):
        if learn:
            seq = tokens(t)
            own_w, own_p, own_s = Counter(seq), Counter(zip(["<s>", *seq], seq, strict=False)), Counter(["<s>", *seq[:-1]])
            for u, w in zip(["<s>", *seq], seq, strict=False):
                c = states[u] - own_s[u]
                if c > 0:
                    left = words[w] - own_w[w]
                    ratio = (pairs[u, w] - own_p[u, w]) / c / ((left - d) / total if left > 0 else d * distinct / total)
                    at = 0 if ratio <= 0 else int(np.clip(np.rint((math.log2(ratio) - lm.LOWEST) / lm.STEP), 0, lm.RATIOS - 2)) + 1
                    histogram[min(int(math.log2(c)), lm.BINS - 1) * lm.RATIOS + at] += 1
    back = lm.backoff_weights(histogram)
    out = []
    for t in texts:
        score, base, known, state = 0.0, 0.0, 0, "<s>"
        for w in tokens(t):
            c = states[state]
            if c:
                b = back[min(int(math.log2(c)), lm.BINS - 1)]
                score += math.log10((1 - b) * pairs[state, w] / c + b * p(w))
            else:
                score += math.log10(p(w))
            base += math.log10((words[w] + 1) / (total + distinct + 1))
            known += words[w] > 0
            state = w
        out.append((len(tokens(t)), known, total, base, score))
    return out


TEXTS = ["The cat sat on the mat", "the cat sat", "the dog sat on the log", None, "", "  \t\n ", "THE CAT SAT on the mat", "zebra quux", "the cat sat on the mat", "a é É b", "x " * 3000]


def scored(spark, docs, texts, train):
    df = docs([(i, t) for i, t in enumerate(texts)]).withColumn("learn", F.col("doc_id").isin([i for i, x in enumerate(train) if x]))
    rows = lm.scored(df, F.col("learn")).collect()
    return {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows}


@pytest.mark.parametrize("train", [[i % 3 != 2 for i in range(len(TEXTS))], [True] * len(TEXTS), [False] * len(TEXTS)])
@pytest.mark.parametrize("block", [1 << 20, 64])
def test_equals_brute_force(spark, docs, monkeypatch, train, block):
    monkeypatch.setattr(gather, "BLOCK_BYTES", block)
    monkeypatch.setattr(gather, "BUCKET_KEYS", 16)
    monkeypatch.setattr(gather, "GROUP_BLOCKS", 2 if block == 64 else 4096)
    got = scored(spark, docs, TEXTS, train)
    for i, want in enumerate(brute(TEXTS, train)):
        assert got[i] == pytest.approx(want, abs=1e-8)


def test_continuations_of_contexts(spark, docs):
    """All continuations of a context, the unknown word among them, in texts that are not learnt from."""
    learnt = ["a b a c", "a b", "c a b b"] * 3
    words, unknown = ["a", "b", "c"], "zz"
    contexts = ["", "a", "b", "c a"]
    asked = contexts + [f"{c} {w}".strip() for c in contexts for w in [*words, unknown]] + [f"{w}" for w in words]
    got = scored(spark, docs, learnt + asked, [True] * len(learnt) + [False] * len(asked))
    score = {t: got[len(learnt) + i][4] for i, t in enumerate(asked)}
    want = dict(zip(asked, brute(learnt + asked, [True] * len(learnt) + [False] * len(asked))[len(learnt) :], strict=True))
    assert all(score[t] == pytest.approx(want[t][4], abs=1e-8) for t in asked)
    # whole texts are events that exclude each other
    assert 0 < sum(10 ** score[t] for t in set(asked)) < 1


def test_repeated_rows_empty_table_and_clashes(spark, docs, with_clashes):
    twice = docs([(1, "a b"), (1, "a b"), (None, "a")])
    assert lm.scored(twice, F.lit(True)).count() == 3
    assert lm.scored(docs([(1, "a")]).limit(0), F.lit(True)).count() == 0
    assert lm.scored(with_clashes(docs([(1, "a"), (2, None)])), F.lit(True)).count() == 2


def test_vocabulary_of_a_million_words(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.concat(F.lit("w"), F.hex(F.xxhash64(F.col("id") * 1000 + k)))))
    df = spark.range(1000).select(F.col("id").alias("doc_id"), text.alias("text"))
    r = lm.scored(df, F.lit(True)).agg(F.sum("n_known").alias("known"), F.min("base_score").alias("least"), F.max("base_score").alias("most")).first()
    # every word is there once, an end for each text
    want = 1000 * math.log10(2 / (1_001_000 + 1_000_001 + 1)) + math.log10(1001 / (1_001_000 + 1_000_001 + 1))
    assert r.known == 1_001_000 and r.least == pytest.approx(want, rel=1e-9) and r.most == pytest.approx(want, rel=1e-9)


def test_query_learns_from_the_right_documents(spark):
    out = QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.001").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 7 == 2 for i in out.doc_id]).all()
    assert (out[~out.held_out].score > out[~out.held_out].base_score).all()
    assert out[out.held_out].score.sum() > out[out.held_out].base_score.sum()


def test_null_id_is_not_held_out(spark):
    assert spark.range(1).select(crc_mod(F.lit(None).cast("long"), 7).alias("m")).first().m == 0
