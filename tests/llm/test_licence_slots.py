"""Sentences with slots: holders of any name, older wordings, headers without a later version."""

import duckdb
import pytest

from plumbline.llm import licences

TOP = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
END = """
THIS SOFTWARE IS PROVIDED BY {0} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {1} BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
OLD = END.format("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS")
THIRD = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
GPL = "This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version {} as\n * published by the Free Software Foundation.\n"
CASES = {
    "BSD-2-Clause": [TOP + OLD, TOP + END.format("JANE DOE", "JANE DOE")],
    "BSD-3-Clause": [
        TOP + THIRD.format("Google Inc.") + OLD,
        TOP + THIRD.format("the Example Institute of Technology at Somewhere") + END.format("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"),
        TOP + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.\n" + END.format("THE AUTHOR", "THE AUTHOR"),
        TOP + "3. The Company's name and logo must not be used to endorse or promote products derived from this software in any way.\n" + OLD,
    ],
    "BSD-4-Clause": [TOP + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software of the University.\n" + THIRD.format("the University") + OLD],
    "GPL-2.0-only": [GPL.format(2)],
    "GPL-3.0-only": [GPL.format(3)],
    "MIT": ["Licensed under the\nMIT license."],
    "": ["No words of that kind.", "", "The author of this software shall be named.", None],
}


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(name, text) for name, own in CASES.items() for text in own]
    return texts, spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")


def test_names_of_licences(rows):
    texts, df = rows
    got = {r.doc_id: (list(dict.fromkeys(r.licences)), r.unmatched) for r in licences.scan(df).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: [name] if name else [] for i, (name, _) in enumerate(texts)}
    assert all(not x[1] for x in got.values())


def test_twin_on_these_texts(spark, rows):
    texts, df = rows
    got = sorted((r.doc_id, ",".join(r.sentence_codes), ",".join(r.licences)) for r in licences.scan(df).collect())
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", [(i, t) for i, (_, t) in enumerate(texts)])
    assert got == sorted((r[0], r[2], r[3]) for r in db.execute(licences.ORACLE["op4_licences"]).fetchall())


def test_every_known_sentence_has_a_telling_word():
    sentences, _ = licences.with_tags(licences.SENTENCES, licences.RULES)
    words = licences.telling_words(sentences)
    assert len(words) < 12 and all(any(w in s for w in words) for s in sentences)
