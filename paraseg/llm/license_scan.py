"""Licence scans by sentence rules.

A text is normalised to words: lower case, runs of anything but letters and digits as one blank. Known sentences are found
at any word, the longest of those that begin first, so it does not matter how a notice is wrapped, indented, commented
or what stands before it. The sequence of a document's sentence identifiers is matched against ordered rules. A rule
matches where its identifiers follow one another, with at most ``GAP`` words in between; its sentences serve no later rule.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraseg.llm.common import arrow_limits

GAP = 24
Sentences = dict[str, list[str]]
Rules = list[tuple[str, list[str]]]

# Sentences that licences and their notices are made of, normalised, by identifier.
PLAIN = {
    "apache-long": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-disclaimer": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl-terms": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "unlicense-domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense-use": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "cc0-dedication": ["to the extent possible under law the author s has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "cc0-copy": ["you should have received a copy of the cc0 public domain dedication along with this software"],
}
# Families of the GNU notices, with their versions.
GNU = {"GPL": ("general", ["2", "3"]), "LGPL": ("lesser general", ["2 1", "3"]), "AGPL": ("affero general", ["3"])}
SUBJECTS = ["program", "library", "file", "software"]
# How short statements name a licence, by SPDX identifier.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu gpl version 2", "gplv2", "gpl v2"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gplv3", "gpl v3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgplv3", "lgpl v3"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agplv3", "agpl v3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "0BSD": ["0bsd license", "zero clause bsd license"],
    "ISC": ["isc license"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "creative commons zero v1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
}
VERBS = ["licensed", "released", "distributed", "available", "published"]
ALSO_SPDX = ["GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"]


def plain(text: str) -> str:
    """As ``normalised``, for the index."""
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def _index() -> tuple[Sentences, Rules]:
    sentences, gnu = {k: list(v) for k, v in PLAIN.items()}, []
    for family, (kind, versions) in GNU.items():
        name = f"gnu {kind} public license"
        for version in versions:
            free = "this {0} is free software you can redistribute it and or modify it under the terms of the {1}".format
            later = [f"{free(s, name)} as published by the free software foundation either version {v} of the license or at your option any later version" for s in SUBJECTS for v in (version, f"{version} 0")]
            only = [f"{free(s, name)} version {version} as published by the free software foundation" for s in SUBJECTS]
            only += [f"{free(s, name)} as published by the free software foundation version {version} of the license" for s in SUBJECTS]
            spdx = f"{family}-{version.replace(' ', '.')}" + (".0" if " " not in version else "")
            sentences[f"{spdx}-or-later"], sentences[f"{spdx}-only"] = later, only
            gnu += [(f"{spdx}-{end}", [f"{spdx}-{end}", "gnu-hope", f"{family}-copy"]) for end in ("or-later", "only")]
        sentences[f"{family}-copy"] = [f"you should have received a copy of the {name} along with this {s}" for s in SUBJECTS]
    sentences["gnu-hope"] = [f"this {s} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose" for s in SUBJECTS]
    rules = [
        ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
        ("Apache-2.0", ["apache-long", "apache-copy", "apache-basis", "apache-see"]),
        ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
        ("MIT", ["mit-grant", "mit-notice", "as-is"]),
        *gnu,
        ("ISC", ["isc-grant", "isc-disclaimer"]),
        ("0BSD", ["0bsd-grant", "isc-disclaimer"]),
        ("MPL-2.0", ["mpl-terms", "mpl-copy"]),
        ("Unlicense", ["unlicense-domain", "unlicense-use"]),
        ("CC0-1.0", ["cc0-dedication", "cc0-copy"]),
        ("MIT", ["mit-grant", "mit-notice"]),
        ("Apache-2.0", ["apache-long"]),
        *[(spdx, [first]) for spdx, (first, *_) in gnu],
        ("ISC", ["isc-grant"]),
        ("MPL-2.0", ["mpl-terms"]),
        ("Unlicense", ["unlicense-domain"]),
        ("CC0-1.0", ["cc0-dedication"]),
    ]
    for spdx, names in NAMES.items():
        sentences[f"short {spdx}"] = [" ".join(x.split()) for verb, the, name in product(VERBS, ("the", "the terms of the", ""), names) for x in [f"{verb} under {the} {name}"]]
        rules.append((spdx, [f"short {spdx}"]))
    for spdx in [*NAMES, *ALSO_SPDX]:
        sentences[f"spdx {spdx}"] = [f"spdx license identifier {plain(spdx)}"]
        rules.append((spdx, [f"spdx {spdx}"]))
    return sentences, rules


SENTENCES, RULES = _index()


def normalised(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def automaton(sentences: Sentences) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in sorted(sentences):
        for text in sentences[name]:
            if text.strip():
                found.add_word(f" {text} ", (len(text), name))
    found.make_automaton()
    return found


def known_sentences(text: str, index: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """First and last word and identifier of the known sentences of a normalised text: leftmost, then longest, none overlapping."""
    if not len(index):
        return []
    hits = [(end - size, -size, name) for end, (size, name) in index.iter(f" {text} ")]
    found, free, word, upto = [], 0, 0, 0
    for start, size, name in sorted(hits):
        if start < free:
            continue
        free = start - size + 1
        # In the padded text, the blank before the first word is place 0, so a blank is before every word.
        word += text.count(" ", upto, start - 1)
        upto = start - 1
        found.append((word, word + text.count(" ", start - 1, start - 1 - size), name))
    return found


def match(sequence: list[tuple[int, int, str]], rules: Rules, gap: int = GAP) -> list[tuple[int, int, int]]:
    """Rule, first and last word of each match in ``(first, last, identifier)`` in order."""
    used, found = [False] * len(sequence), []
    held = Counter(name for _, _, name in sequence)
    for rule, (_, names) in enumerate(rules):
        if any(name not in held for name in names):
            continue
        for i in range(len(sequence) - len(names) + 1):
            window = range(i, i + len(names))
            fits = all(not used[j] and sequence[j][2] == name for j, name in zip(window, names))
            if fits and all(sequence[j + 1][0] - sequence[j][1] <= gap + 1 for j in window[:-1]):
                for j in window:
                    used[j] = True
                found.append((rule, sequence[i][0], sequence[window[-1]][1]))
    return found


def _match_rows(sentences: Sentences, rules: Rules, gap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = automaton(sentences)
        for batch in batches:
            rows = []
            for doc, h, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(doc, h, rules[rule][0], rule, a, z) for rule, a, z in match(known_sentences(text, index), rules, gap)]
            if rows:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["doc_id", "h", "license", "rule", "first_word", "last_word"])

    return run


def needed_words(sentences: Sentences) -> list[str]:
    """Words of which every known sentence has one: those that most sentences share, chosen one by one."""
    left, chosen = [set(text.split()) for texts in sentences.values() for text in texts if text.strip()], []
    while left:
        counts = Counter(word for words in left for word in words if len(word) > 4) or Counter(word for words in left for word in words)
        word = min(counts, key=lambda w: (-counts[w], w))
        chosen.append(word)
        left = [words for words in left if word not in words]
    return chosen


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: Sentences | None = None, rules: Rules | None = None, gap: int = GAP
) -> DataFrame:
    """``(doc_id, license, rule, first_word, last_word)``: one row for each match of a rule in a document.

    ``rule`` is the rule's place in the order, words of the normalised text count from 0. ``sentences`` (normalised as by
    ``plain``) and ``rules`` replace the index of this module. A licence can match more than once. Null and empty texts
    match nothing; rows that repeat an id are scanned apart if their texts differ; ids of any type are kept; extra
    columns are ignored.
    """
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    words = needed_words(sentences)
    if all(re.fullmatch("[a-z0-9]+", word) for word in words):
        rows = rows.filter(F.regexp_like("text", F.lit("(?i)" + "|".join(words))) if words else F.lit(False))
    arrow_limits(docs.sparkSession)
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), normalised(F.col("text")).alias("words"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_match_rows(sentences, rules, gap), f"doc_id {kind}, h long, license string, rule int, first_word int, last_word int").distinct().drop("h")
