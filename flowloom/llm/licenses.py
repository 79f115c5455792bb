"""Licence recognition by sentence rules.

A text is cut into sentences, each is normalised (lower case, every run of characters other than
letters and digits one space), and looked up in a table of known licence sentences. The identifiers
that it gives, in text order, are matched against ordered rules: a rule is a sequence of
identifiers that must occur in this order, with no more than ``gap`` other known sentences between
two of them. A rule with more sentences wins over the rules whose match lies inside its own.

A licence text may be wrapped, and a known sentence may itself hold colons, semicolons or full stops
of abbreviations. So sentences are cut into lines too, and from each line, left to right, every run
of lines is looked up as long as a known sentence begins like it; the longest that is known counts,
and the search goes on behind it. Neither a heading without a full stop nor a further licence line
hides a sentence.

Defined results: null and empty texts have no sentences and no licences; a licence that occurs more
than once is listed once, at its first place; sentences that look like licence text but are not
known are counted as unknown.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

# Identifiers and normalised wording of well-known licence sentences.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache2-licensed": "licensed under the apache license version 2 0",
    "apache2-may-not-use": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl3-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc0": "released under cc0 1 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "apache2-to-you": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "apache2-asf": "the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-short": "apache license version 2 0",
    "lgpl21-or-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-or-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl3-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl1": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost": "distributed under the boost software license version 1 0",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}

# Licence and the ordered sentences that show it.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache2-may-not-use", "apache2-obtain", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-may-not-use",)),
    ("Apache-2.0", ("apache2-licensed",)),
    ("GPL-3.0-or-later", ("gpl3-or-later", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl3-or-later",)),
    ("GPL-2.0-or-later", ("gpl2-or-later", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-or-later",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-licensed",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2", "mpl2-copy")),
    ("MPL-2.0", ("mpl2",)),
    ("Apache-2.0", ("apache2-to-you", "apache2-asf", "apache2-obtain", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-asf",)),
    ("Apache-2.0", ("apache2-short",)),
    ("LGPL-2.1-or-later", ("lgpl21-or-later", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-or-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-or-later", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-or-later",)),
    ("AGPL-3.0-or-later", ("agpl3-or-later", "gpl-hope", "agpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-or-later",)),
    ("GPL-2.0", ("gpl2-only", "gpl-hope", "gpl-details")),
    ("GPL-2.0", ("gpl2-only",)),
    ("EPL-2.0", ("epl2",)),
    ("EPL-1.0", ("epl1",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("boost",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
]

#: a word of one of these stems is in every known sentence, and makes an unknown one look like licence text
STEMS = ("licen", "permission", "copyright", "warrant", "redistribut", "cc by", "cc0", "liable", "endorse", "mpl", "public domain")
GAP = 2

_RULES_OF = {name: [r for r in RULES if r[1][0] == name] for name in SENTENCES}
_REACH = max(len(rule) for _, rule in RULES) * (GAP + 1)
_BY_TEXT = {text: name for name, text in SENTENCES.items()}
_BEGINNINGS = {" ".join(w[:n]) for w in map(str.split, _BY_TEXT) for n in range(1, len(w) + 1)}
_LIKELY = re.compile("licen|permission|copyright|warrant|redistribut|cc.{0,3}by|cc0|liable|endorse|mpl|public domain", re.IGNORECASE | re.DOTALL)
_END = re.compile(r"[.:;!?](?=\s|$)|\n[^\S\n]*\n")
_OTHER = re.compile(r"[\W_]+")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def sentence_ids(text: str | None) -> tuple[list[str], int]:
    """Identifiers of the known licence sentences in text order, and the number of unknown ones that look like licence text."""
    found: list[str] = []
    if not text or not _LIKELY.search(text):
        return found, 0
    parts: list[tuple[str, int]] = []  # normalised lines of sentences that are not empty, and the sentence's number
    likely = []
    at = 0
    for k, stop in enumerate([*(m.end() for m in _END.finditer(text)), len(text)]):
        raw, at = text[at:stop], stop
        likely.append(bool(_LIKELY.search(raw)))
        parts += [(x, k) for x in map(normalise, raw.split("\n")) if x]
    known: set[int] = set()
    i = 0
    while i < len(parts):
        run, j, end = "", i, i
        while j < len(parts):
            run = f"{run} {parts[j][0]}" if run else parts[j][0]
            if run not in _BEGINNINGS:
                break
            j += 1
            if run in _BY_TEXT:
                name, end = _BY_TEXT[run], j
        if end > i:
            found.append(name)
            known.update(k for _, k in parts[i:end])
        i = max(end, i + 1)
    return found, sum(x and k not in known for k, x in enumerate(likely))


def match(ids: list[str]) -> list[str]:
    """Licences whose rules the sequence fulfils, by the place where they begin."""
    spans = []
    for first, begins in enumerate(ids):
        for licence, rule in _RULES_OF.get(begins, ()):
            at = first
            for want in rule[1:]:
                at = next((j for j in range(at + 1, min(at + 2 + GAP, len(ids))) if ids[j] == want), None)
                if at is None:
                    break
            if at is not None:
                spans.append((first, at, licence, len(rule)))
    # a span that begins no later and ends no earlier holds another; rules are short, so it begins at most a rule's reach before
    by_start: dict[int, list] = {}
    for s in spans:
        by_start.setdefault(s[0], []).append(s)
    around = lambda s: (t for a in range(max(0, s[0] - _REACH), s[0] + 1) for t in by_start.get(a, ()))
    best = [s for s in spans if not any(s[1] <= t[1] and t[3] > s[3] for t in around(s))]
    return list(dict.fromkeys(licence for _, _, licence, _ in sorted(best, key=lambda s: (s[0], -s[3], s[2]))))


_KIND = pa.struct([("sentences", pa.list_(pa.string())), ("licenses", pa.list_(pa.string())), ("unknown", pa.int32())])


def scan_column(column: pa.Array) -> pa.Array:
    out = []
    for x in column:
        ids, unknown = sentence_ids(x.as_py())
        out.append({"sentences": ids, "licenses": match(ids), "unknown": unknown})
    return pa.array(out, _KIND)


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, a struct of sentences, licenses and unknown; and that column's name."""
    small_batches(docs.sparkSession)
    name = fresh(docs, "licence")
    recognise = F.arrow_udf(scan_column, "struct<sentences:array<string>,licenses:array<string>,unknown:int>")
    return docs.withColumn(name, recognise(F.col(text))), name
