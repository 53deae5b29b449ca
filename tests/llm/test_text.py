import gc
import math
import random
import re
import textwrap
import time
from collections import Counter

import helpers
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lumenflow.llm import exact_packing, license_rules, line_blocks, pii_boost, quality_llr, sp_nbest, subword_classifier


def test_main_text():
    page = """<!DOCTYPE html><html><body class="menu"><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Title</h1><p>First &amp; <b>bold</b>\n  text<p>Second<br>line</p>
    <form>Join <input></form><script>var t="</p>";</script><div id="comments"><p>Nice!</p></div></article><aside>More</aside><footer>c</footer>"""
    assert line_blocks.main_text(page) == "Title\nFirst & bold text\nSecond line"
    assert line_blocks.main_text("<p>a</p>") == "a"
    assert [line_blocks.main_text(x) for x in (None, "", "<p>", "<script>x")] == ["", "", "", ""]


def test_main_text_by_density():
    body = [f"Sentence number {i} of the story, in a plain division that is as long as paragraphs are." for i in range(4)]
    plain = "".join(f"<div>{x}</div>" for x in body)
    menu = "<div>Home</div><div>News</div><div>Shop</div><div>Help</div><div>About</div>"
    assert line_blocks.main_text(f"<article class=card><a href=x>Teaser</a></article>{plain}") == "\n".join(body)
    assert line_blocks.main_text(f"{plain}{menu}") == "\n".join([*body, "Home", "News"])  # the dive is two lines behind the last dense one
    dense = [x * 3 for x in body]
    form = "".join(f"<p>{x}</p>" for x in dense)
    assert line_blocks.main_text(f"<form>{form}</form>") == "\n".join(dense)
    assert line_blocks.main_text(f"<article><p>{body[0]}</p><div class=ad>Buy it</div><p>The end.</p></article><div class=comments>{plain}</div>") == f"{body[0]}\nThe end."
    assert line_blocks.main_text("<nav>" + "".join(f"<li><a href=x>{x * 9}</a>" for x in body) + "</nav><p>a</p>") == "a"
    assert line_blocks.passages([40, 0, 50, 0, 0, 29, 0, 0, 85, 0, 0, 0, 0, 86]) == [(0, 5), (11, 14)]


def test_passages_against_brute_force():
    """A passage is a run of lines under windows of DIVE or more, one of which is SURGE or more."""
    rng = random.Random(2)
    for _ in range(300):
        n = [rng.choice([0, 0, 5, 20, 60, 90]) for _ in range(rng.randint(0, 25))]
        sums = [sum(n[i : i + 3]) for i in range(len(n))]
        runs, lit = [], {i: max(sums[j] for j in range(max(0, i - 2), i + 1) if sums[j] >= 30) for i in range(len(n)) if any(sums[j] >= 30 for j in range(max(0, i - 2), i + 1))}
        starts = [i for i in range(len(n)) if sums[i] >= 30]
        for i in starts:  # windows that touch belong to one passage
            if runs and i < runs[-1][1]:
                runs[-1] = (runs[-1][0], min(i + 3, len(n)), max(runs[-1][2], sums[i]))
            else:
                runs.append((i, min(i + 3, len(n)), sums[i]))
        assert line_blocks.passages(n) == [(s, e) for s, e, top in runs if top >= 86] and set(lit) == {i for s, e, _ in runs for i in range(s, e)}


def test_attributes_headers_and_forms():
    body = "This is a paragraph that is long enough to be text of an article, with many words in it."
    page = f'<body><form><nav>Menu</nav><article><div class="article-header"><h1>Title</h1></div><p title="the hidden truth">{body}</p><p hidden>unseen</p><div class="ad">Buy</div><p>End.</p></article></form></body>'
    assert line_blocks.main_text(page) == f"Title\n{body}\nEnd."


@pytest.mark.parametrize("page", ["<div>" * 20000 + "</b>" * 20000, "<b>" * 20000 + "<dt></dt>" * 20000, "<li><div>" + "<b>" * 20000 + "<li></li>" * 20000, "<b><td>" + "<div>" * 20000 + "</b>" * 20000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    line_blocks.main_text(page)
    assert time.process_time() - began < 5


def test_extract_cases(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)]
    got = line_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")).collect()
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]


def test_quality_rules_against_brute_force(spark):
    texts = ["a b c a b c x", "a a a a a a", "x\nx\n\n \n y\nx", "#$ <>|", " ".join(f"w{i}" for i in range(60)), " ".join(["p q r s t"] * 20), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS w", "'' AS u")
    labels = spark.createDataFrame([(4, 1), (5, 0), (99, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_llr.judge(docs, labels).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in enumerate(texts):
        t = t or ""
        w = word.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(tri)
        covered = {k + d for k, x in enumerate(tri) if n[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
    assert got[4].kept and not got[5].kept and not got[6].kept
    assert quality_llr.judge(docs.filter("false"), labels.filter("false")).count() == 0


def test_quality_verdict_against_brute_force(spark, monkeypatch):
    """Scores and threshold by plain arithmetic; hashes are Spark's."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh" if i < 30 else "qrstuvwxyz") + str(rng.randrange(40)) for _ in range(80)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(i, 0) for i in range(40, 60)], "doc_id long, quality int")
    hashes = docs.selectExpr("doc_id", "transform(split(text, ' '), x -> xxhash64(x)) AS u").selectExpr("doc_id", "u", "transform(sequence(1, size(u) - 1), i -> xxhash64(u[i - 1], u[i])) AS d").collect()
    grams = {r.doc_id: [x % quality_llr.BUCKETS for x in [*r.u, *r.d]] for r in hashes}
    target, raw = Counter(b for i in range(20) for b in grams[i]), Counter(b for g in grams.values() for b in g)
    n, t, r = quality_llr.BUCKETS, sum(target.values()), sum(raw.values())
    weight = {b: round(1000 * (math.log((target[b] + 1) / (t + n)) - math.log((raw[b] + 1) / (r + n)))) for b in raw}
    score = {i: sum(weight[b] for b in g) / len(g) for i, g in grams.items()}
    least = min(math.floor(100 * score[i]) for i in range(20))
    got = {r.doc_id: r for r in quality_llr.judge(docs, labels).collect()}
    for i in grams:
        assert abs(got[i].score - score[i] / 1000) < 1e-9 and got[i].kept == (not got[i].base_failed and 100 * score[i] >= least)
    assert all(got[i].kept for i in range(20)) and not any(got[i].kept for i in range(30, 60))


def test_repeats_are_compared_by_words(spark):
    """The hashes of the first and last window of a text agree in the 44 bits that its length leaves of them."""
    filler = " ".join(f"w{i}" for i in range(600_000))
    texts = [f"a2270743 b c {filler} a8705264 b c", f"a2270743 b c {filler} a2270743 b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_llr.score(docs, [0] * quality_llr.BUCKETS).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {0: 0, 1: 6}


def test_license_scan(spark):
    rows = [
        (1, "Hello.\nLicensed under the Apache License, Version 2.0.\nBye."),
        (2, "Released under the MIT License. All rights reserved."),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this. The above copyright notice and this permission notice shall be included in all. The software is provided 'as is', without warranty of any kind."),
        (4, "Some licence talk that nobody knows."),
        (None, None),
    ]
    got = {r.doc_id: (r.licenses, r.verdict, r.n_sentences, r.n_unmatched) for r in license_rules.licenses(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sequence", "2 AS names")).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0", 1, 0), 2: ("MIT,Proprietary", "multiple", 2, 0), 3: ("MIT", "MIT", 3, 0), 4: ("", "unknown", 1, 1), None: ("", "none", 0, 0)}


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-or-later": """Copyright (C) 2020 Some Body

This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0-or-later": """Copyright (C) 2020 Some Body

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "BSD-3-Clause": """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
_LESSER = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""
_AFFERO = NOTICES["GPL-3.0-or-later"].replace("General", "Affero General")
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.

3. This notice may not be removed or altered from any source distribution."""
_MOZILLA = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: Notices without a heading or a line of the holder.
BARE = {
    "LGPL-2.1-or-later": _LESSER,
    "LGPL-2.0-or-later": _LESSER.replace("Lesser", "Library").replace("2.1", "2"),
    "LGPL-3.0-or-later": _AFFERO.replace("Affero", "Lesser").split("\n\n", 1)[1],
    "AGPL-3.0-or-later": _AFFERO.split("\n\n", 1)[1],
    "AGPL-3.0": _AFFERO.replace("either version 3 of the License, or (at your option) any later version", "version 3 of the License").split("\n\n", 1)[1],
    "ISC": _ISC,
    "0BSD": _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "Zlib": _ZLIB,
    "MPL-2.0": _MOZILLA,
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
NOTICES["BSD-2-Clause"] = re.sub(r"3\. Neither.*?\n\n", "", NOTICES["BSD-3-Clause"], flags=re.S)


def test_license_notices(spark):
    cases = []
    for name, text in NOTICES.items():
        for width in (50, 60, 79, 10_000):
            wrapped = "\n\n".join("\n".join(textwrap.wrap(x, width, break_long_words=False)) if "All rights" not in x else x for x in text.split("\n\n"))
            cases += [(name, wrapped), (name, wrapped.replace("\n", "\r\n")), (name, "\n".join(f" * {x}".rstrip() for x in wrapped.split("\n"))), (name, re.sub(r"(?m)^([123])\.", r"(\1)", wrapped))]
        cases += [(name, " ".join(text.split("\n\n", 1)[1].split())), (name, f"Some text.\n{text}\nOther text.")]
    cases += [("MIT", "Released under the MIT License\nOther words"), ("MIT", "Words; released under the MIT License; words"), ("Apache-2.0", 'Licensed under the Apache\nLicense, Version 2.0\n(the "License");\nyou may not use this file except in compliance with the License')]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_rules.licenses(docs).collect()}
    assert [(i, got[i].verdict, got[i].sequence) for i, (name, _) in enumerate(cases) if got[i].verdict != name] == []
    whole = {name: got[i] for i, (name, text) in enumerate(cases) if text == f"Some text.\n{NOTICES.get(name)}\nOther text."}
    assert {name: (r.sequence.count("unknown"), r.n_unmatched) for name, r in whole.items()} == {name: (1 + (name == "MIT"),) * 2 for name in NOTICES}  # the heading and the line of the holder


def test_license_notices_of_other_families(spark):
    cases = []
    for name, text in BARE.items():
        for width in (50, 79, 10_000):
            wrapped = "\n\n".join("\n".join(textwrap.wrap(x, width, break_long_words=False)) for x in text.split("\n\n"))
            cases += [(name, wrapped), (name, "\n".join(f"# {x}".rstrip() for x in wrapped.split("\n"))), (name, f"Some text.\n\n{wrapped}\n\nOther text.")]
    spdx = {"MIT": "MIT", "GPL-2.0-only": "GPL-2.0", "GPL-2.0": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0-or-later", "LGPL-2.1-or-later": "LGPL-2.1-or-later", "BSD-3-Clause": "BSD-3-Clause", "0BSD": "0BSD", "MIT OR Apache-2.0": "unknown", "Foo-1.0": "unknown", "MIT-0": "unknown"}
    for said, name in spdx.items():
        cases += [(name, f"SPDX-License-Identifier: {said}"), (name, f"// SPDX-License-Identifier: {said}\nimport os\n"), (name, f"#!/bin/sh\n/* SPDX-License-Identifier: {said} */\n\nint x;")]
    cases += [("none", "They were hereby gone to the public domain.")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_rules.licenses(docs).collect()}
    assert [(cases[i], got[i].verdict, got[i].sequence) for i, (name, _) in enumerate(cases) if got[i].verdict != name] == []


def test_nbest_against_all_paths():
    m = sp_nbest.lattice(str(public_tokenizers.path("piece_bpe_32k.model")))

    def paths(s, at=0, score=0.0):
        if at == len(s):
            return [score]
        out, node, j, single = [], m._root, at, False
        while j < len(s) and s[j] in node:
            node = node[s[j]]
            j += 1
            if "" in node:
                single = single or j == at + 1
                out += paths(s, j, score + node[""][0])
        return out if single else out + paths(s, at + 1, score + m._unknown)

    for text in ("the cat", "  a b", "é\nx", "thethethe", "a"):
        found = m.nbest(text, 6)
        assert [s for s, _ in found] == sorted(paths(sp_nbest.MARK + text.replace(" ", sp_nbest.MARK)), reverse=True)[:6]
        assert len({i for _, i in found}) == len(found)
        assert all(m.decode(i) == text for _, i in found)


def test_memo_is_bounded_by_bytes(monkeypatch):
    m = sp_nbest.PieceLattice(str(public_tokenizers.path("piece_bpe_32k.model")))
    monkeypatch.setattr(sp_nbest, "MEMO_BYTES", 20_000)
    first = m.nbest("word0 and more", 3)
    for i in range(500):
        m.nbest(f"word{i} {i * 7919} text", 3)
        assert m._held[0] <= 20_000 and m._held[1] <= 5_000
    before = len(m._memo)
    m.nbest("x" * 5000, 3)
    assert len(m._memo) == before and m.nbest("word0 and more", 3) == first


def test_nbest_unit_costs_and_no_collections():
    """The first backward steps agree with the whole search, ties and unknown characters too; the memo is not collected as it grows."""
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    m = sp_nbest.lattice(path)
    mark, pieces = sp_nbest.MARK, "the ing er and on é ß \n 漢 \u0378 a aa b , .".split(" ")
    for k in range(400):
        unit = mark * (k % 3) + "".join(pieces[(k * 7919 >> s) % len(pieces)] for s in range(k % 7)) or mark
        score, ids, cost = m._learn(unit)
        two = m.unit_paths(unit, 2)
        assert (score, ids) == two[0] and cost == (score - two[1][0] if len(two) > 1 else float("inf"))
    ran = []
    gc.callbacks.append(lambda phase, info: ran.append(phase))
    try:
        texts = pa.array([" ".join(f"w{k * 7919 + i}x{k}" for i in range(300)) for k in range(40)])
        batches = [pa.RecordBatch.from_arrays([pa.array(range(40)), texts], names=["doc_id", "text"])]
        out = sp_nbest._encode(path, 4, False)(iter(batches))
        del ran[:]
        assert next(out).num_rows == 40 and not ran
        out.close()
        assert gc.isenabled()
    finally:
        gc.callbacks.pop()


def test_nbest_cases(spark):
    got = sp_nbest.segment(helpers.documents(spark), str(public_tokenizers.path("piece_bpe_32k.model")), keep_ids=True).collect()
    assert len(got) == len(helpers.TEXTS) and all(r.round_trip for r in got)
    assert all(r.n_best == 1 and list(r.n_pieces) == [0] for r in got if r.doc_id in (1, 7))


def test_classifier_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = subword_classifier.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_classifier_cases(spark):
    labels = spark.createDataFrame([(5, 1), (None, 0), (8, None)], "doc_id long, quality int")
    got = subword_classifier.classify(helpers.documents(spark), labels).collect()
    assert len(got) == len(helpers.TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert subword_classifier.keep_good(helpers.documents(spark, []), labels).count() == 0


@pytest.mark.parametrize("text", ["a.b@c.d.e,x@y", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111-1111 1111", "+1 (348) 555-6390.", "é+49 30 1234567", "@a.b a@b", "1" * 50, "+1+12345678901"])
def test_base_spans(text):
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and pii_boost.luhn(digits(m))]
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    assert pii_boost.base_spans(text) == sorted(want, key=lambda x: (x[1], pii_boost.KINDS.index(x[0])))


@pytest.mark.parametrize("text, kinds", [("see pages 415-555-2671 here", []), ("call 415-555-2671 now", ["phone"]), ("mail john at example dot com please", ["email"]), ("we met at home dot", []), ("jane.doe [at] example [dot] org", ["email"])])
def test_candidates_are_judged_in_context(text, kinds):
    assert [k for k, _, _ in pii_boost.find_spans(text, *pii_boost.model())[1]] == kinds


def test_overlaps_are_found_at_any_number():
    rng = random.Random(1)
    for n in (3, 80):
        base = [("card", s, s + rng.randint(1, 9)) for s in sorted(rng.sample(range(1000), n))]
        more = [("phone", s, s + rng.randint(1, 9)) for s in rng.sample(range(1000), 300)]
        assert pii_boost._apart(more, base) == [c for c in more if not any(c[1] < e and s < c[2] for _, s, e in base)]


def test_added_spans_and_redaction(spark):
    trees, least = pii_boost.model()
    assert pii_boost.redact("call (415) 555-2671 or a@b.cd, 2024-01-15", trees, least) == "call [PHONE] or [EMAIL], 2024-01-15"
    assert pii_boost.redact(None, trees, least) is None
    got = pii_boost.find_personal_data(helpers.documents(spark)).collect()
    assert len(got) == len(helpers.TEXTS) and all(r.spans == "" for r in got)


def test_packing(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = exact_packing.pack(helpers.documents(spark), path).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for text in ("don't  stop\n\n 12 é", helpers.LONG[:5000], "\x1c\x85 x", "a" * 9000):
        assert np.frombuffer(exact_packing.tokenizer(path).encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    for text in ("a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|"):
        assert np.frombuffer(exact_packing.tokenizer(path).encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 8)
    assert all(n == 2048 for _, _, n in long[1:]) and [s for _, s, _ in long] == [sum(x[2] for x in long[:i]) for i in range(len(long))]
    assert exact_packing.pack(helpers.documents(spark, []), path).count() == 0


def fewest(pieces, capacity):
    """Least number of bins, by trying all places."""
    pieces = sorted(pieces, reverse=True)
    best = [len(pieces)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(bins)
            return
        for k in {gap: k for k, gap in enumerate(bins) if gap >= pieces[i]}.values():
            go(i + 1, [*bins[:k], bins[k] - pieces[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - pieces[i]])

    go(0, [])
    return best[0]


def test_plans_of_small_histograms_against_brute_force():
    rng = np.random.default_rng(5)
    over = 0
    for _ in range(150):
        capacity = int(rng.integers(5, 40))
        pieces = rng.integers(1, capacity + 1, int(rng.integers(1, 11))).tolist()
        plan = exact_packing.plan(dict(Counter(pieces)), capacity)
        assert sorted(x for lengths, k in plan for x in lengths * k) == sorted(pieces) and all(sum(lengths) <= capacity for lengths, _ in plan)
        over += sum(k for _, k in plan) - fewest(pieces, capacity)
    assert over <= 3


def test_sums_index_against_brute_force():
    left = np.zeros(41, dtype=np.int64)
    left[[3, 5, 8, 11, 20, 31]] = 2
    index, have = exact_packing.SumIndex(left), [3, 5, 8, 11, 20, 31]
    for gap in range(1, 41):
        assert index.single(gap) == [(x,) for x in have if x == gap]
        assert sorted(index.pairs(gap)) == sorted((a, b) for a in have for b in have if a >= b and a + b == gap)
        assert sorted({tuple(sorted(x)) for x in index.triples(gap)}) == sorted({tuple(sorted((a, b, c))) for a in have for b in have for c in have if a + b + c == gap})


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(2)
    counts = Counter(int(x) for x in rng.integers(1, 2049, 5000))
    plan = exact_packing.plan(dict(counts))
    used = Counter()
    for lengths, k in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += k
    assert used == counts
    least = max(sum(x * n for x, n in counts.items()) / 2048, sum(n for x, n in counts.items() if x > 1024))
    assert sum(k for _, k in plan) <= 1.01 * least + 1
