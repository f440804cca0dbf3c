"""Licence scans: rules, full texts in several forms, and any index, against a plain rendering."""

from __future__ import annotations

import random
import re
import textwrap

import pytest

from paraseg.llm import license_scan as scan

ROWS = "doc_id long, text string, h long, words string, license int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], ROWS)


def told(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["doc_id"], []).append((r["license"], r["rule"], r["first_word"], r["last_word"]))
    return {i: sorted(rows) for i, rows in out.items()}


def test_rules_and_odd_rows(spark):
    bsd = ".\n".join(s[0] for n, s in scan.SENTENCES.items() if n.startswith("bsd"))
    short = "Licensed under the Apache License, Version 2.0.\nx\nLicensed under CC BY-NC 4.0."
    rows = [(1, "Some words. Released under the MIT License.\nMore."), (2, short), (2, short), (3, "This program is distributed in the hope of profit."), (4, None), (5, bsd), (6, ""), (None, short)]
    found = scan.scan(frame(spark, rows)).collect()
    both = [("Apache-2.0", 0, 7), ("CC-BY-NC-4.0", 9, 15)]
    assert sorted(((r["doc_id"], r["license"], r["first_word"], r["last_word"]) for r in found), key=repr) == sorted(
        [(1, "MIT", 2, 6), (5, "BSD-3-Clause", 0, len(scan.plain(bsd).split()) - 1), *[(i, *x) for i in (2, None) for x in both]], key=repr
    )
    assert scan.scan(frame(spark, [])).count() == 0
    assert scan.scan(frame(spark, rows), sentences={}, rules=[]).count() == 0


def plain_matches(text, sentences, rules, gap=scan.GAP):
    """Every word tried as the beginning of every known sentence; then the rules in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    known = sorted(((x.split(), name) for name, texts in sentences.items() for x in texts), key=lambda k: (-len(" ".join(k[0])), k[1]))
    sequence, i = [], 0
    while i < len(words):
        hit = next(((w, n) for w, n in known if words[i : i + len(w)] == w), None)
        if hit:
            sequence.append([i, i + len(hit[0]) - 1, hit[1], False])
        i += len(hit[0]) if hit else 1
    found = []
    for number, (spdx, names) in enumerate(rules):
        for k in range(len(sequence) - len(names) + 1):
            part = sequence[k : k + len(names)]
            if [p[2] for p in part] == names and not any(p[3] for p in part) and all(b[0] - a[1] <= gap + 1 for a, b in zip(part, part[1:])):
                for p in part:
                    p[3] = True
                found.append((spdx, number, part[0][0], part[-1][1]))
    return sorted(found)


def test_any_index_equals_brute_force(spark):
    rng = random.Random(13)
    sentences = {"a": ["we grant you", "we grant you all"], "b": ["no warranty"], "c": ["you all know", "keep this notice"], "d": ["grant you"]}
    rules = [("X", ["a", "b", "c"]), ("Y", ["a", "b"]), ("Z", ["a"]), ("N", ["c", "c"]), ("D", ["d"])]
    pieces = ["We grant", "you", "all", "NO warranty!", "Keep this\n# notice", "know", "word", "-", "grant"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(25)))) for i in range(400)]
    found = told(scan.scan(frame(spark, rows), sentences=sentences, rules=rules, gap=3))
    assert {m[0] for matches in found.values() for m in matches} == set("XYZND")
    assert all(found.get(i, []) == plain_matches(t, sentences, rules, 3) for i, t in rows)


def test_own_index_equals_brute_force(spark):
    """The module's sentences, cut and put together again, with words between them."""
    rng = random.Random(14)
    own = [x for texts in scan.SENTENCES.values() for x in texts]
    rows = [(i, ". ".join(rng.choice([x, x.title(), " ".join(x.split()[: rng.randrange(1, 9)]), "some words"]) for x in rng.sample(own, 5))) for i in range(150)]
    found = told(scan.scan(frame(spark, rows)))
    assert len(found) > 50 and all(found.get(i, []) == plain_matches(t, scan.SENTENCES, scan.RULES) for i, t in rows)


@pytest.mark.parametrize(("text", "expected"), [
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("Code is released under the MIT license.", "MIT"), ("The data is licensed under the MIT License, see the file.", "MIT"),
    ("This file is distributed under the terms of the GNU General Public License, version 2.", "GPL-2.0-only"),
])
def test_short_statements(text, expected):
    index = scan.automaton(scan.SENTENCES)
    found = scan.match(scan.known_sentences(scan.plain(text), index), scan.RULES)
    assert [scan.RULES[rule][0] for rule, *_ in found] == [expected]


def test_a_text_of_many_notices(spark):
    text = "Released under the MIT License. Words in between. " * 40_000
    [row] = scan.scan(frame(spark, [(1, text)])).groupBy("license").count().collect()
    assert tuple(row) == ("MIT", 40_000)


LICENSE_TEXTS = {
    "MIT": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.""",
    "Apache-2.0": """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.

If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.

You should have received a copy of the CC0 Public Domain Dedication along with this software.""",
}


def test_full_texts_in_any_form(spark):
    """As they are, wrapped, commented, and in one line after a title: each is one match of the licence's longest rule."""
    rows, names = [], []
    for name, text in LICENSE_TEXTS.items():
        parts = text.split("\n\n")
        wrapped = "\n\n".join(textwrap.fill(x, 70) for x in parts)
        for form in (text, wrapped, textwrap.indent(wrapped, "# ", lambda line: True), name + " License " + " ".join(x.strip() for x in parts)):
            rows.append((len(rows), form))
            names.append(name)
    found = scan.scan(frame(spark, rows)).collect()
    longest = {n: max(len(seq) for spdx, seq in scan.RULES if spdx == n) for n in names}
    assert sorted((r["doc_id"], r["license"]) for r in found) == list(enumerate(names))
    assert all(len(scan.RULES[r["rule"]][1]) == longest[r["license"]] for r in found)
