"""Operators that work text by text: languages, licences, quality, toxicity."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.llm import langid, licenses, quality, toxicity
from flowloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
EN, FR = "the cat and the other thing with that ", "le chat et les autres choses avec cela "
ODD = [(1, None), (2, ""), (3, "1234 ... !!"), (4, "— … ☃"), (5, "a"), (6, "漢字"), (7, EN * 20000), (8, EN), (8, EN)]


def learnt(docs):
    return docs([(100 + i, (EN if i % 2 else FR) * 5, "en" if i % 2 else "fr") for i in range(20)] + [(200, None, "xx"), (201, "text", None)])


def test_languages(docs, with_clashes):
    out, at = langid.identify(with_clashes(docs([*ODD, (9, FR)])), learnt(docs))
    assert at not in ("language", "score") and "own language" in {r.language for r in out.collect()}
    got = {r.doc_id: (r[at].lang_pred, r[at].score) for r in out.collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("und", 0.0)] * 4
    assert got[5][0] in ("en", "fr") and got[6][0] in ("en", "fr") and got[6][1] < 0.2
    assert got[7][0] == got[8][0] == "en" and got[9][0] == "fr" and got[8][1] > 0.8
    assert out.count() == len(ODD) + 1
    kept = out.where(langid.accepted(F.col(at), 0.4)).select("doc_id").collect()
    assert {r.doc_id for r in kept} >= {7, 8, 9} and not {r.doc_id for r in kept} & {1, 2, 3, 4, 6}


def test_no_training_text_and_no_rows(docs):
    out, at = langid.identify(docs([(1, EN)]), docs([(1, EN)]).limit(0))
    assert out.first()[at].lang_pred == "und"
    assert langid.identify(docs([(1, EN)]).limit(0), learnt(docs))[0].count() == 0


def test_many_languages_use_several_planes(docs):
    r = random.Random(1)
    words = {f"l{k}": ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(20)] for k in range(19)}
    train = docs([(i, " ".join(r.choice(words[name]) for _ in range(60)), name) for i in range(3) for name in words])
    model = langid.fit(train)
    assert len(model.planes) == 3
    import pyarrow as pa

    got, _ = langid.predict_batch(model, pa.array([" ".join(words[n][:9]) for n in model.langs]))
    assert got == model.langs


def test_filters_answer_for_every_kept_gram(docs):
    model = langid.fit(learnt(docs))
    import pyarrow as pa

    for name, text in (("en", EN), ("fr", FR)):
        got, score = langid.predict_batch(model, pa.array([text * 3]))
        assert got == [name] and score[0] > 0.9
    assert (model.false_rate < 0.05).all()


def test_language_of_held_out_documents(spark):
    out = QUERIES["op9_language_id"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "lang"]))
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.99
    assert out.score.between(0, 1).all()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("No licence here.", []), ("Released under the MIT License.", ["MIT"]), ("x\nLicensed under the Apache License, Version 2.0.\ny", ["Apache-2.0"]),
        ("Title\nThis work is licensed under the GNU General\nPublic License, version 3.", ["GPL-3.0"]), ("LICENSED under CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
        ("Released under the MIT License. Licensed under CC BY 4.0. Released under the MIT License.", ["MIT", "CC-BY-4.0"]), ("The MIT License was released under pressure.", []),
    ],
)
def test_licences(text, want):
    assert licenses.match(licenses.sentence_ids(text)[0]) == want


def test_ordered_rules_win_over_their_parts():
    s = licenses.SENTENCES
    bsd = [s[k].capitalize() + "." for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]
    assert licenses.match(licenses.sentence_ids(" ".join(bsd))[0]) == ["BSD-3-Clause"]
    assert licenses.match(licenses.sentence_ids(" ".join(bsd[:3]))[0]) == ["BSD-2-Clause"]
    assert licenses.match(licenses.sentence_ids(" ".join([bsd[2], bsd[1], bsd[0]]))[0]) == []
    assert licenses.match(["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]) == ["MIT"]
    assert licenses.match(["bsd-redistribution", "cc0", "cc0", "cc0", "bsd-source", "bsd-binary"]) == ["CC0-1.0"]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."


@pytest.mark.parametrize(
    ("text", "ids", "want"),
    [
        (APACHE, ["apache2-may-not-use", "apache2-obtain", "apache2-as-is", "apache2-see"], "Apache-2.0"),
        (GPL % (":", ",", 3), ["gpl3-or-later", "gpl-hope", "gpl-details"], "GPL-3.0-or-later"),
        (GPL % (";", ";", 2), ["gpl2-or-later", "gpl-hope", "gpl-details"], "GPL-2.0-or-later"),
        (MPL, ["mpl2"], "MPL-2.0"),
    ],
)
def test_punctuated_licence_headers(text, ids, want):
    for wrapped in (text, "".join(f"# {x}\n" for x in text.splitlines()), f"A heading\n{text}"):
        assert licenses.sentence_ids(wrapped)[0] == ids
        assert licenses.match(licenses.sentence_ids(wrapped)[0]) == [want]


def test_all_licences_of_lines_without_stops():
    ids = lambda text: licenses.sentence_ids(text)[0]
    assert ids("Licensed under the MIT License\nLicensed under CC BY 4.0") == ["mit-licensed", "cc-by-4"]
    assert ids("Title\nThis work is licensed under the GNU General\nPublic License, version 3\nAnother line") == ["gpl3-work"]
    assert ids("Title\nLicensed under\nCC BY 4.0\nText\nReleased under the MIT License\nEnd") == ["cc-by-4", "mit-released"]
    assert licenses.sentence_ids("A strange license\nLicensed under CC BY 4.0. Another strange license.") == (["cc-by-4"], 1)


def matched_plainly(ids):
    """All spans of all rules, and those that no longer rule's span holds."""
    spans = []
    for licence, rule in licenses.RULES:
        for i in range(len(ids)):
            at = [i] if ids[i] == rule[0] else []
            for want in rule[1:] if at else ():
                nearer = [j for j in range(at[-1] + 1, len(ids)) if ids[j] == want and j - at[-1] <= licenses.GAP + 1]
                if not nearer:
                    at = []
                    break
                at.append(nearer[0])
            if at:
                spans.append((at[0], at[-1], licence, len(rule)))
    best = sorted((s for s in spans if not any(t[0] <= s[0] and s[1] <= t[1] and t[3] > s[3] for t in spans)), key=lambda s: (s[0], -s[3], s[2]))
    return list(dict.fromkeys(s[2] for s in best))


def test_rules_equal_a_plain_search():
    r = random.Random(11)
    names = list(licenses.SENTENCES)
    for _ in range(400):
        rule = r.choice(licenses.RULES)[1]
        ids = [x for name in rule for x in [name] + [r.choice(names)] * r.choice([0, 0, 0, 1, 3])] + r.choices(names, k=r.randint(0, 5))
        assert licenses.match(ids) == matched_plainly(ids)


def test_a_very_long_text_takes_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        text = "\n".join(f"some license line {i} without a stop" for i in range(n)) + "\nReleased under the MIT License\n" * n
        began = time.perf_counter()
        ids, _ = licenses.sentence_ids(text)
        assert licenses.match(ids) == ["MIT"] and len(ids) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_every_known_sentence_is_looked_at():
    for name, text in licenses.SENTENCES.items():
        assert licenses.sentence_ids(text.upper() + ".")[0] == [name]
        assert licenses.normalise(text) == text
    assert {x for _, rule in licenses.RULES for x in rule} <= set(licenses.SENTENCES)
    assert licenses.sentence_ids("This license is a strange one.") == ([], 1)


def test_licence_scan_keeps_rows_and_columns(docs, with_clashes):
    out, at = licenses.scan(with_clashes(docs([*ODD, (9, "Released under the MIT License.")])))
    assert at != "licence" and {r.doc_id: r[at].licenses for r in out.collect()}[9] == ["MIT"] and out.count() == len(ODD) + 1
    assert licenses.scan(docs([(1, "a")]).limit(0))[0].count() == 0


def test_licences_of_documents_by_plain_search(spark):
    known = {"released under the mit license": "MIT", "licensed under the apache license, version 2.0": "Apache-2.0", "gnu general public license, version 3": "GPL-3.0", "licensed under cc by-nc 4.0": "CC-BY-NC-4.0"}
    texts = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"]).set_index("doc_id").text
    for r in QUERIES["op2_license_scan"](spark, SF).collect():
        assert sorted(filter(None, r.licenses.split(","))) == sorted({v for k, v in known.items() if k in texts[r.doc_id].lower()})


def test_quality(spark, docs, with_clashes):
    out = QUERIES["op4_quality"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"))
    assert (out.kept == (out.quality == 1)).mean() > 0.98
    labels = spark.createDataFrame([(100 + i, int(i % 2)) for i in range(40)] + [(100, 1), (999, 0), (None, 1), (101, None)], "doc_id long, quality int")
    train = docs([(100 + i, EN * (4 + i % 7) if i % 2 else "!! XX ## " * (15 + i)) for i in range(40)])
    model = quality.fit(train, labels)
    judged, at = quality.score(with_clashes(docs([*ODD, (9, "## QQ !! " * 20, None), (10, EN * 7)]).withColumn("source", F.lit(None).cast("string"))), model)
    got = {r.doc_id: r[at].score for r in judged.collect()}
    assert got[10] > 0.5 > got[9] and judged.count() == len(ODD) + 2 and all(0 <= x <= 1 for x in got.values())
    assert quality.score(train.limit(0), model)[0].count() == 0


def test_quality_without_both_classes(spark, docs):
    train = docs([(1, EN), (2, FR)])
    for rows, want in (([], 1.0), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)):
        model = quality.fit(train, spark.createDataFrame(rows, "doc_id long, quality int"))
        judged, at = quality.score(train, model)
        assert {r[at].score for r in judged.collect()} == {want}


def test_cotraining_passes_labels_between_views():
    r = np.random.default_rng(2)
    y = (r.random(4000) < 0.8).astype(float)
    a, b = y[:, None] * 3 + r.normal(size=(4000, 2)), y[:, None] * 3 + r.normal(size=(4000, 3))
    text, page, blend = quality.cotrain(a[:60], b[:60], y[:60], a[60:2000], b[60:2000])
    both = np.stack([text.logit(a[2000:]), page.logit(b[2000:])], axis=1) @ blend[:2] + blend[2]
    assert ((both > 0) == y[2000:]).mean() > 0.97


def test_toxicity(spark, docs, with_clashes):
    out = QUERIES["op10_toxicity"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"))
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.88 and held[held.toxic == 0].predicted.mean() < 0.06
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()
    r = random.Random(3)
    plain = lambda n: " ".join("".join(r.choice(["an", "er", "th", "on", "re"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rude = lambda: plain(30) + " nasty " + plain(9) + " gruesome " + plain(9) + " nasty " + plain(20)
    rows = [(i, rude() if i % 3 == 0 else plain(70)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(1, None), (None, 1), (9999, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels)
    scored, at = toxicity.score(with_clashes(docs([*ODD, (900, rude()), (901, plain(70))])), model)
    got = {x.doc_id: x[at] for x in scored.collect()}
    assert got[900] >= 0.7 > got[901] and got[1] == got[2] < 0.7 and scored.count() == len(ODD) + 2


def test_toxicity_without_both_classes(spark, docs):
    for rows, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        model = toxicity.fit(docs([(1, EN), (2, FR)]), spark.createDataFrame(rows, "doc_id long, toxic int"))
        scored, at = toxicity.score(docs([(1, EN), (3, None)]), model)
        assert {x[at] for x in scored.collect()} == {want}


def test_toxicity_equals_plain_scoring_of_the_model(spark, docs):
    """Window by window with the library, from the fitted dictionaries and weights."""
    import pyarrow as pa
    import zstandard

    r = random.Random(5)
    plain = lambda n: " ".join("".join(r.choice(["an", "er", "th", "on"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, plain(60) + (" horrid nasty fool " + plain(9) if i % 3 == 0 else "")) for i in range(240)]
    model = toxicity.fit(docs(rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int"))
    texts = [rows[0][1], rows[1][1], "", "x" * 500, rows[3][1] * 30]

    def plainly(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        cuts = [0]
        for k in range(1, -(-len(raw) // 64)):
            gaps = [g for g in range(k * 64 - 31, k * 64 + 1) if raw[g : g + 1] in (b" ", b"\n", b"\t")]
            cuts.append(gaps[-1] if gaps else k * 64)
        ws = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)] if raw else []
        size = lambda content, w: len(zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(model.base + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(w))
        pairs = [([size(o, w) for o, _ in model.pairs], [size(t, w) for _, t in model.pairs]) for w in ws]
        x = [np.log1p(len(ws))]
        for saved in ([np.mean(o) - np.mean(t) for o, t in pairs], [min(o) - np.mean(t) for o, t in pairs], [min(o) - max(t) for o, t in pairs]):
            squares = sum(max(v, 0) ** 2 for v in saved)
            x += [max(saved, default=0), np.log1p(squares), squares / np.sqrt(len(ws) + 3)]
        z = ((np.array(x) - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    got = toxicity.Scorer(model).probability(pa.array(texts))
    assert got == pytest.approx([plainly(t) for t in texts], abs=0.02)


def test_all_lengths_of_text_are_fitted_on(spark, docs):
    r = random.Random(6)
    plain = lambda n: " ".join("".join(r.choice(["an", "er", "th", "on"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    # all toxic texts are long, and the toxic words stand at their ends
    rows = [(i, plain(5000) + " horrid nasty fool" * 20 if i % 3 == 0 else plain(60)) for i in range(60)]
    model = toxicity.fit(docs(rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    assert model.constant is None and len(model.pairs) == toxicity.PAIRS and all(len(x) == toxicity.PAIR_BYTES for p in model.pairs for x in p)
    import pyarrow as pa

    drawn = toxicity.excerpt(pa.array([rows[0][1], None, "", "short"]), 640).to_pylist()
    assert len(drawn[0]) == 10 and drawn[1:] == [[], [], [b"short"]] and rows[0][1].encode().find(drawn[0][-1]) > 0.8 * len(rows[0][1])


def test_languages_equal_plain_scoring_of_the_model(docs):
    import pyarrow as pa

    model = langid.fit(learnt(docs))
    mask = 2**64 - 1

    def plainly(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        folded = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
        grams = [folded[i : i + 4] for i in range(len(folded) - 3) if folded[i : i + 4].count(b" ") <= 1]
        bits = int(np.log2(len(model.planes[0])))
        hits = [0.0] * len(model.langs)
        for g in grams:
            code = int.from_bytes(g, "little")
            slots = [(code * m & mask) >> (64 - bits) for m in langid._MULTIPLIERS]
            for k in range(len(hits)):
                hits[k] += all(model.planes[k // 8][s] >> (k % 8) & 1 for s in slots)
        fixed = [max(0.0, (h - len(grams) * f) / max(1e-9, 1 - f)) for h, f in zip(hits, model.false_rate, strict=True)]
        best = max(range(len(fixed)), key=lambda k: (fixed[k], -k))
        return (model.langs[best], min(1.0, fixed[best] / max(len(grams), 1))) if any(c.isalpha() for c in text) else ("und", 0.0)

    texts = [EN, FR, EN + FR * 2, "a", "12 !", "", "漢字 thé", "ÀÉÎ le chat", EN * 40]
    got, score = langid.predict_batch(model, pa.array(texts))
    want = [plainly(t) for t in texts]
    assert got == [w[0] for w in want] and score == pytest.approx([w[1] for w in want])


def test_quality_equals_plain_scoring_of_the_model(spark, docs):
    import math
    import re

    labels = spark.createDataFrame([(100 + i, int(i % 2)) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs([(100 + i, EN * (4 + i % 7) if i % 2 else "!! XX ## " * (15 + i)) for i in range(40)]), labels)
    rows = [(1, EN * 3, "en", "s", 90), (2, "## QQ !! 12\n\nNew line, é", None, "t", None), (3, "", "fr", None, 0), (4, None, "en", "s", 5), (5, "aa aa bb", "zz", "s", -3)]

    def logit(view, x):
        z = [min(6.0, max(-6.0, (a - m) / s)) for a, m, s in zip(x, view.mean, view.scale, strict=True)]
        return view.slope * (sum(a * w for a, w in zip(z, view.weights[:-1], strict=True)) + view.weights[-1]) + view.shift

    def shape(text):
        raw = (text or "").encode()
        n, one = len(raw), max(len(raw), 1)
        count = lambda keep: sum(map(keep, raw))
        upper, lower, digit = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: 48 <= b <= 57)
        space, newline, stop = count(lambda b: b == 32 or 9 <= b <= 13), raw.count(b"\n"), count(lambda b: b in b".,;:?'\"-()")
        symbol = count(lambda b: 33 <= b < 127) - upper - lower - digit - stop
        w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
        k = max(len(w), 1)
        return [
            math.log1p(n), upper / max(upper + lower, 1), digit / one, space / one, newline / one * 20, stop / one, symbol / one, count(lambda b: b >= 128) / one, min(sum(map(len, w)) / k, 40) / 10,
            min(symbol / k, 4), len(set(w)) / k**0.75, sum(a == b for a, b in zip(w, w[1:], strict=False)) / k, stop / k, min(n / (newline + 1), 2000) / 1000,
        ]

    def plainly(text, lang, source, n_chars):
        length = -1 if n_chars is None else max(n_chars, 0)
        size = math.log1p(max(length, 0))
        rate = lambda kind, v: model.rates[kind].get(v, model.rates[""])
        t, p = logit(model.text, shape(text)), logit(model.page, [size, float(length < 0), size**2 / 10, rate("lang", lang), rate("source", source)])
        return [1 / (1 + math.exp(-z)) for z in (t, p, t * model.blend[0] + p * model.blend[1] + model.blend[2])]

    judged, at = quality.score(docs(rows), model)
    for r in judged.collect():
        want = plainly(*next(x[1:] for x in rows if x[0] == r.doc_id))
        assert list(r[at]) == pytest.approx(want, abs=1e-9)


def test_windows_cover_every_byte():
    import pyarrow as pa

    from flowloom.llm.textbytes import column_bytes

    data, offsets = column_bytes(pa.array([EN * 50, "x" * 1000, None, "", "short"]))
    start, end, text = toxicity.windows(data, offsets)
    for i in range(5):
        own = [(a, b) for a, b, t in zip(start, end, text, strict=True) if t == i]
        assert b"".join(bytes(data[a:b]) for a, b in own) == bytes(data[offsets[i] : offsets[i + 1]])
