"""Quality rules, source mixing and the licence scan against plain re-computations on small tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from articleflow.llm import licenses, mixing, quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_counts(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    inside = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(inside))


CLEAN = "Der schnelle Fuchs läuft über die Brücke.\nEr sieht den alten Hund am Ufer liegen und bleibt stehen."
TEXTS = [
    CLEAN, None, "", "   \n\t ", "too short", "a b c d e f a b c d e g h i j a b c d e",
    "\n".join(["one line that is said again and again"] * 5) + "\nand another line of plain words here",
    " | ".join(["home", "news", "about", "contact", "login", "help", "more", "less"]),
    "wow!! now!! buy!! this!! thing!! here!! at!! once!! dear!! reader!! please!!",
    "THIS IS ALL IN CAPITALS AND NOTHING ELSE IS TO BE SEEN IN THIS LINE OF TEXT",
    "x*** y### z$$$ a%%% b&&& c*** d### e$$$ f%%% g&&& h***", "wort " * 5000,
    "ein wort\x1cist\x0bgeteilt\x0cund nochmals gezählt " * 3, CLEAN,
]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t), t
        n, rep = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    assert got[0].kept and got[13].kept
    assert not any(got[i].kept for i in (1, 2, 3, 7, 8, 9, 10, 11))


def test_clean_documents_drops_lines_and_documents(spark):
    rows = [(1, CLEAN, "de", "a", 0, "x"), (2, CLEAN + "\nhome | news | about | more | login", "de", "a", 0, "y"),
            (None, CLEAN, None, None, None, "z"), (3, "home | news | about | more | login | help | top", "en", "b", 0, "w"),
            (1, CLEAN, "de", "a", 0, "x")]
    df = spark.createDataFrame(rows, DOCS + ", n_words string")
    out = quality.clean_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 1, 2, None])
    assert all(r.text == CLEAN and r.n_chars == len(CLEAN) for r in got)
    assert quality.clean_documents(df.limit(0)).count() == 0 and quality.judge(df.limit(0)).count() == 0


def prose(n, seed):
    """``n`` words whose frequencies fall with their rank, as in a text of about 0.3 different words at 3,000."""
    import random

    rng = random.Random(seed)
    return [f"w{int(4_000 ** rng.random())}" for _ in range(n)]


def test_long_clean_lines_stay_and_long_monotone_lines_go(spark):
    clean = {n: " ".join(prose(n, n)) for n in (1_000, 5_000, 20_000)}
    assert all(len(set(t.split())) < 0.4 * n for n, t in clean.items() if n > 1_000)
    junk = [" ".join(prose(30, 1) * 100), "wort " * 5_000, " ".join(f"v{i % 200}" for i in range(600))]
    df = spark.createDataFrame([*clean.items(), *enumerate(junk)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(got[n].kept and got[n].kept_words == n and not got[n].failed_lines for n in clean)
    assert all(got[i].failed_lines == 1 and not got[i].kept for i in range(len(junk)))
    assert sorted(r.text for r in quality.clean_documents(df).collect()) == sorted(clean.values())
    rules = quality.LineRules()
    for n, d in ((10, 3), (10, 4), (500, 199), (500, 200)):  # a constant share up to the scale
        words = [b"%d" % (i % d) for i in range(n)]
        assert (quality.line_fails(b" ".join(words), words, rules) == "monotone") == (d < 0.4 * n)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= over
    return target


def test_mix_meets_every_target(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 7}" if i % 11 else None) for i in range(400)]
    rows += [(1000, None, "empty"), (1001, "", "empty"), (5, "w w w", "s1"), (5, "w w w", "s1"), (None, "a b", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, rows_per_range=20).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert targets[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - targets[s]) <= 0.5
        assert {r.source_size for r in got if r.source == s} == {sizes[s]}
    again = mixing.mix(df.repartition(5), rows_per_range=10_000).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_whole_documents_and_empty_tables(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 3}", 1, i) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS + ", size long")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    times = Counter(r.doc_id for r in out.collect())
    want = {r.doc_id: r.epochs for r in mixing.mix(df, cut="document").collect()}
    assert times == Counter({d: n for d, n in want.items() if n}) and max(times.values()) <= 2
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_license_sentences_rules_and_order(spark):
    assert all(any(c in s for c in licenses.CUES) for s in licenses.SENTENCES.values())
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)
    grant = ("Licensed under the Apache License, Version 2.0 (the \"License\"); You may not use this file except in "
             "compliance with the License.")
    rows = [(1, "Some text. Released under the MIT License.\nMore text"), (2, grant), (3, None), (4, ""),
            (5, "Released under the MIT Licence! Licensed under CC BY-NC 4.0."), (6, "no rights at all, plain words."),
            (7, "You may obtain a copy of the License at"), (8, "This license is homemade. Do as you like."),
            (9, "Released under the MIT License. " * 3), (10, "x " * 200_000 + ". All rights reserved."),
            (2, grant), (None, "ALL RIGHTS RESERVED")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licenses string")
    got = [tuple(r)[1:5] for r in licenses.scan(df).collect()]
    assert got == [("MIT", 1, 0, 0), ("Apache-2.0", 1, 0, 0), ("NONE", 0, 0, 0), ("NONE", 0, 0, 0),
                   ("CC-BY-NC-4.0 AND MIT", 2, 0, 0), ("NONE", 0, 0, 0), ("NONE", 0, 1, 0), ("NONE", 0, 0, 1),
                   ("MIT", 3, 0, 0), ("Proprietary", 1, 0, 0), ("Apache-2.0", 1, 0, 0), ("Proprietary", 1, 0, 0)]
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert licenses.scan(df.filter(F.col("doc_id") == 6)).first().licenses == "NONE"


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "BSD-3-Clause": """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""}


def test_canonical_notices_are_found_wrapped_or_not(spark):
    bsd3, gpl = NOTICES["BSD-3-Clause"], NOTICES["GPL-3.0-or-later"]
    at = bsd3.index("3. Neither")
    texts = [*NOTICES.items(), ("BSD-2-Clause", bsd3[:at] + bsd3[bsd3.index("THIS"):]),
             ("BSD-3-Clause", bsd3.replace("the copyright holder nor", "Example University nor").replace(
                 "BY THE COPYRIGHT HOLDERS AND", "BY THE REGENTS AND").replace("SHALL THE COPYRIGHT HOLDER OR", "SHALL THE REGENTS OR").replace("\n1. ", "\n* ")),
             ("GPL-2.0-or-later", gpl.replace("software: you", "software; you").replace("version 3", "version 2")),
             ("MIT", "\n".join(" * " + x for x in NOTICES["MIT"].split("\n"))),
             ("MIT", NOTICES["MIT"].replace("\n", "\r\n")),
             ("MIT AND Proprietary", "All rights reserved.\n\nSome words.\nReleased under\nthe MIT License\nMore words")]
    texts += [(k, re.sub(r"(?<!\n)\n(?!\n)[ *#]*", " ", t)) for k, t in NOTICES.items()]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = licenses.scan(df).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [k for k, _ in texts]
    assert [r.n_unmatched for r in got] == [0] * len(texts), [(r.licenses, r.sentence_ids) for r in got if r.n_unmatched]
    apart = spark.createDataFrame([(1, "Released under\n\nthe MIT License"), (2, "Released under. the MIT License")], df.schema)
    assert [r.licenses for r in licenses.scan(apart).collect()] == ["NONE", "NONE"]


def test_slices_bound_the_bytes_and_keep_all_rows():
    import pyarrow as pa

    from articleflow.llm.common import SLICE_BYTES, slices

    sizes = [0, 10, SLICE_BYTES + 5, 3, SLICE_BYTES // 2, SLICE_BYTES // 2, 7, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n == 3 else "x" * n for n in sizes])], names=["i", "t"])
    parts = list(slices(iter([batch, batch.slice(0, 0)]), 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(sizes)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= SLICE_BYTES for p in parts)


def test_a_holder_of_any_length_keeps_the_licence(spark):
    holder = "the " + "Very Long Institute of Sciences " * 30
    text = NOTICES["BSD-3-Clause"].replace("the copyright holder nor", holder.strip() + " nor")
    assert [r.licenses for r in licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == ["BSD-3-Clause"]
