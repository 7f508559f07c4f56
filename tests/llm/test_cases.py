"""The defined cases of every operator and pipeline stage: very long texts, repeated rows, odd letters, clashing columns,
empty tables; and queries against slow versions of themselves."""

import itertools
import math
import random
import struct
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, crf, html_text, licences, media, mixing, near_copies, neighbours, sharding, simhash, token_counts, toxicity
from test_pipeline import fixture

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def long_texts():
    rng = random.Random(9)
    japanese = "".join(rng.choice("日本語の文章です東京大学私は今日行きます。") for _ in range(60_000))
    return [japanese, "".join(rng.choice("абвгд еж. ") for _ in range(120_000)), "a" * 70_000, "word, the <|endoftext|> 12 it's " * 5_000]


def test_long_texts_have_the_librarys_tokens(spark, library):
    df = spark.createDataFrame(list(enumerate(long_texts())), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(long_texts())}
    for r in bpe.encode(df, decoded="n_tokens").collect():
        assert r.ids == want[r.doc_id] and r.n_tokens == long_texts()[r.doc_id]
    for r in token_counts.count_tokens(df).collect():
        assert r.n_tokens == len(want[r.doc_id])


def test_token_counts_of_one_piece_above_the_limit(library, monkeypatch):
    counter = token_counts.Counter(bpe.default_path())
    monkeypatch.setattr(token_counts, "UNSAFE", 1_000)
    text = "b" * 60_000
    assert counter([text, "x y"]) == [len(library.encode(text, add_special_tokens=False).ids), 2]
    parts = token_counts.pieces("ab<|endoftext|>, cd " * 50, 30, counter.special)
    assert "".join(parts) == "ab<|endoftext|>, cd " * 50 and len(parts) > 10 and not any("<|" in p and p.count("<|") != p.count("|>") for p in parts)


def test_a_vocabulary_with_options_is_refused(tmp_path):
    import json

    file = json.load(open(bpe.default_path(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        (tmp_path / "x.json").write_text(json.dumps(file | change))
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.compile_file(str(tmp_path / "x.json"))


# ---- op2


@pytest.fixture(scope="module")
def extractor():
    return html_text.train(html_text.labelled_pages())


@pytest.mark.parametrize("unit", ["<div>x", '<a "', "<b>x", '<div class="c">x', "<script ", "<!-- ", "<i><div></i>", "<li>x<ul>", "</p>", "&#9", "<a '\"> "])
def test_html_is_linear(extractor, unit):
    start = time.time()
    extractor(unit * (200_000 // len(unit)))
    assert time.time() - start < 8  # seconds where squares took minutes


def test_html_query_equals_brute_force(spark, extractor, tmp_path):
    pages = [(i, p, known) for i, (p, known) in enumerate(html_text.labelled_pages(60, seed=31))]
    rows = [(i, f"u{i}", p) for i, p, _ in pages] + [(100, None, None), (101, "u", ""), (0, "u0", pages[0][1]), (102, "u", "&#" + "9" * 6000 + ";"), (None, "u", "<article><p>Words of it, here.</p></article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    got = html_text.op2_html(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    exact = sum(r.text == "\n\n".join(t for t, y in pages[r.page_id][2] if y) for r in got if r.page_id is not None and r.page_id < 60)
    assert exact >= 0.9 * 61
    for i, page, _ in pages:
        blocks = html_text.leaf_blocks(page)
        s = np.array([sum(extractor.weights.get(f, 0.0) for f in set(own)) for own in html_text.block_features(blocks)])
        assert np.allclose(s, html_text.block_scores(blocks, extractor.weights))
        if len(blocks) <= 12:  # every labelling of the page
            best = max(itertools.product((0, 1), repeat=len(s)), key=lambda y: sum(s * y) + sum(extractor.trans[a, b] for a, b in itertools.pairwise(y)))
            assert next(r.text for r in got if r.page_id == i) == "\n\n".join(b.text for b, y in zip(blocks, best, strict=True) if y)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html_text.op2_html(spark, f"{tmp_path}/none").count() == 0


# ---- op3


def recall(spark, x, **options):
    df = spark.createDataFrame([(i + 7, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, "vec_id % 90 = 5", **options).collect()
    hits, asked = 0, [i for i in range(len(x)) if (i + 7) % 90 == 5]
    for i in asked:
        near = np.lexsort((np.arange(len(x)), np.where(np.arange(len(x)) == i, np.inf, ((x - x[i]) ** 2).sum(axis=1))))[:10] + 7
        hits += len(set(near.tolist()) & {r.vec_id for r in got if r.query_id == i + 7})
    return hits / (10 * len(asked))


def test_neighbours_of_isotropic_and_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    assert recall(spark, rng.normal(size=(4000, 32))) >= 0.9
    assert recall(spark, rng.normal(size=(60, 32))[rng.integers(0, 60, 4000)] + 0.2 * rng.normal(size=(4000, 32))) >= 0.9


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    once = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    twice = once.union(once).union(once.filter("vec_id % 100 = 0"))
    for block in (16, 4096):
        a, b = (sorted(map(tuple, neighbours.search(df, "vec_id % 100 = 0", coverage=1.0, rerank=400, block=block).collect())) for df in (once, twice))
        assert a == b and len(a) == 30 and len({(q, v) for q, _, v, _ in a}) == 30


# ---- op4

ISC = """Copyright (c) 2020, Somebody <a@b.c>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD_END = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_licence_texts(spark):
    import textwrap

    from test_wrapped_licences import BSD, MIT

    two = BSD[: BSD.index("\n3.")] + BSD_END
    cases = [(ISC, "ISC", "ia ib ic"), (MPL, "MPL-2.0", "pa pb"), (BSD + BSD_END, "BSD-3-Clause", "ba bb bc bd be bf"), (two, "BSD-2-Clause", "ba bb bc be bf"), (MIT, "MIT", "mt mg mn mw ml")]
    cases += [(f"                                 {name}\n          Version {v}\n\nPreamble", want, code) for name, v, want, code in (("GNU GENERAL PUBLIC LICENSE", "3, 29 June 2007", "GPL-3.0-only", "gt"), ("Apache License", "2.0, January 2004", "Apache-2.0", "at"))]
    rows, want = [], []
    for text, name, codes in cases:
        for width in (64, 79, 100_000):
            for lead in ("", " * ", "// "):
                rows.append((len(rows), "\n".join(lead + x for line in text.split("\n") for x in (textwrap.wrap(line, width) or [""]))))
                want.append(([name], codes.split()))
        rows.append((len(rows), " ".join(text.split())))  # on one line
        want.append(([name], codes.split()))
    rows.append((len(rows), "/* SPDX-License-Identifier: Apache-2.0 */\nint x;\n# SPDX-License-Identifier: GPL-2.0-or-later\n"))
    want.append((["Apache-2.0", "GPL-2.0-or-later"], None))
    rows.append((len(rows), "x; : . \n" * 40_000 + MPL + " .;:\n" * 40_000))  # very long
    want.append((["MPL-2.0"], ["pa", "pb"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    for i, (names, codes) in enumerate(want):
        one_line = i < 10 * len(cases) and i % 10 == 9 and rows[i][1].startswith(("Copyright", "Redistribution", "The MIT", "GNU", "Apache"))
        assert got[i].licences == names or one_line, (rows[i][1][:300], got[i])
        assert codes is None or got[i].sentence_codes == codes or one_line, (rows[i][1][:300], got[i])
    assert licences.scan(df.limit(0)).count() == 0
    mine = licences.scan(df.limit(1).withColumn("text", F.lit("Mine alone.\nNo rights.")), sentences={"mine alone": "zq"}, rules=[("Own", "zq")]).first()
    assert mine.licences == ["Own"]


# ---- op5


def test_media_headers_by_the_formats_definition():
    for bits, size, hertz, samples in (("fffb9000", 417, 44100, 1152), ("fffb9200", 418, 44100, 1152), ("fff38000", 208, 22050, 576), ("ffe31000", 52, 11025, 576), ("fffd8000", 417, 44100, 1152), ("ffff8000", 276, 44100, 384)):
        h = media.header(bytes.fromhex(bits), 0)
        assert (h.size, h.hertz, h.samples) == (size, hertz, samples)
    for bits in ("fffbf000", "fffb0000", "fffb9c00", "ffe99000", "fff99000"):  # bad or free rate, bad frequency, reserved version or layer
        assert media.header(bytes.fromhex(bits), 0) is None


def silent(n, body=b""):
    """128 kbit/s, 44.1 kHz, stereo, no CRC: 417 bytes a frame, by hand."""
    return [bytes.fromhex("fffb9000") + bytes(32) + (body if i == 0 else b"").ljust(381, b"\0") for i in range(n)]


def test_media_tables_and_tags():
    frames = silent(9)
    xing = silent(1, b"Xing" + struct.pack(">III", 15, 9, 4170) + bytes(range(0, 200, 2)) + struct.pack(">I", 57))
    title = "Ünï".encode("utf-8")
    tag = b"ID3\x04\0\0" + bytes([0, 0, 0, 11 + len(title)]) + b"TIT2" + bytes([0, 0, 0, 1 + len(title)]) + b"\0\0\x03" + title
    end = b"TAG" + b"Old title".ljust(30, b"\0") + bytes(95)
    got = media.read_stream(tag + b"".join(xing + frames) + end)
    assert got["tags"] == {"TIT2": "Ünï", "v1_title": "Old title"} and got["vbr_ok"] and got["intact"]
    assert (got["vbr_frames"], got["vbr_bytes"], got["vbr_quality"], got["frames"], got["samples"], got["skipped"]) == (9, 4170, 57, 9, 9 * 1152, 0)
    assert got["seek"] == [2 * i * 4170 // 256 for i in range(100)] and got["offsets"][0] == len(tag) + 417
    fewer = media.read_stream(b"".join(xing + frames[:-1]))
    assert fewer["vbr_ok"] is False and not fewer["intact"]
    vbri = bytes.fromhex("fffb9000") + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 80, 4170, 9, 3, 2, 2, 3) + struct.pack(">HHH", 100, 200, 300)
    got = media.read_stream(vbri.ljust(417, b"\0") + b"".join(frames))
    assert (got["vbr_frames"], got["vbr_bytes"], got["vbr_quality"], got["seek"], got["vbr_ok"]) == (9, 4170, 80, [200, 600, 1200], True)


def test_media_bad_checksums_give_no_payload(spark):
    stream = media.write_stream(bytes(range(256)) * 10)
    at = media.read_stream(stream)["offsets"][1]
    broken = bytearray(stream)
    broken[at + 8] ^= 4
    got = media.read_stream(bytes(broken))
    assert got["crc_bad"] == 1 and not got["intact"] and len(got["payload"]) < 2560 and got["frames"] == 3
    df = spark.createDataFrame([(1, None, "x"), (2, bytearray(b"z" * 3_000_000), "y"), (2, bytearray(b"z" * 3_000_000), "y")], "doc_id long, payload binary, frames string")
    rows = sorted(media.read(media.write(df)).collect(), key=lambda r: r.doc_id)
    assert [len(r.payload) for r in rows] == [0, 3_000_000, 3_000_000] and rows[1] == rows[2] and rows[0].frames == 0
    assert media.read(media.write(df.limit(0))).count() == 0


# ---- op7, op9, op10


def test_sharding_columns_and_writes(spark, tmp_path):
    df = spark.createDataFrame([(i % 50, "s" * (i % 3)) for i in range(300)], "doc_id long, `a.b` string").withColumn("slot", F.lit("clash"))
    placed = sharding.place(df, "doc_id")
    assert placed.columns == ["doc_id", "a.b", "slot", "shard"] and sharding.place(df.limit(0), "doc_id").count() == 0
    sharding.write(df, f"{tmp_path}/out", "doc_id")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.shard) for r in back.collect()) == Counter((r.doc_id, r.shard) for r in placed.collect())
    long_key = spark.createDataFrame([("k" * 100_000,), (None,)], "doc_id string")
    assert sharding.place(long_key, "doc_id").count() == 2


def test_mixing_of_a_rare_source(spark):
    df = spark.range(60_000).selectExpr("id as doc_id", "if(id = 0, 'rare', 'a') as source", "'k' as shuffle_key", "'v' as `x.y`")
    table = mixing.rates(df.select("source"))
    assert table.agg(F.max(F.size("upto"))).first()[0] <= 122
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "source", "x.y", "copy", "shuffle_key"]
    rows = {r.source: r for r in got.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "copy").alias("d")).collect()}
    assert abs(rows["rare"].n / 30_000 - 1) < 0.03 and rows["rare"].n == rows["rare"].d and abs(rows["a"].n / 30_000 - 1) < 0.03
    odd = spark.createDataFrame([(None, None), (None, None), (3, "b")], "doc_id long, source string")
    assert mixing.mix(odd).filter("doc_id is null").groupBy("copy").count().filter("count <> 2").count() == 0


def test_mixing_in_blocks_of_parts(spark, monkeypatch):
    df = spark.range(3_000).selectExpr("id as doc_id", "if(id < 2, 'rare', 'a') as source")
    whole = sorted(tuple(r) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BLOCK", 3)
    assert sorted(tuple(r) for r in mixing.mix(df).collect()) == whole


def test_simhash_reads_no_clashing_columns(spark):
    text = "the same words again and again " * 4000
    df = spark.createDataFrame([(2, text, "x"), (1, text, "y"), (1, text, "y")], "doc_id long, text string, fp string").withColumn("component_id", F.lit("z"))
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(1, 1), (2, 1)}


def test_near_copies_in_large_connected_parts(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(120)]
    other = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):  # two large groups of copies, a chain that leads from one away, and strangers
        own = list(base if i < 40 else other)
        own[i * 2] = f"x{i}"
        rows.append((i, " ".join(own)))
    step = list(base)
    for i in range(60, 75):
        step = list(step)
        step[(i * 8) % 120] = f"y{i}"
        rows.append((i, " ".join(step)))
    rows += [(80 + i, " ".join(rng.choice(words) for _ in range(90))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (5, 256):
        led = near_copies.components(spark, near_copies.links(df, block=block))
        names = {r.node: r.doc_id for r in df.select(near_copies.node("text").alias("node"), "doc_id").collect()}
        groups = {}
        for r in led.collect():
            groups.setdefault(r.root, {names[r.root]}).add(names[r.node])
        assert sorted(map(sorted, groups.values())) == [[*range(40), *range(60, 75)], list(range(40, 60))]


# ---- op8


def test_toxicity_offsets_and_long_sentences(spark, tmp_path):
    fixture(spark, str(tmp_path))
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rng = random.Random(3)
    plain = " ".join(rng.choice(["abc", "dede", "fig", "VILEWORDX" if rng.random() < 0.01 else "hij"]) for _ in range(3000))
    texts = [None, "", "İİİ calm. vilewordx", plain, "İ vilewordx nastyxx İ", "!" * 100_000, "vilewordx", "vilewordx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.tag(df, model).collect()}
    assert [texts[2][s.start : s.end] for s in got[2].spans] == ["vilewordx"] and got[6].score == got[7].score and got[0].score == got[1].score
    for i, text in enumerate(texts):  # the same by plain sums, sentence by sentence
        p = []
        for sentence in "".join(c if c not in ".!?\n" else "\n" for c in text or "").split("\n"):
            words = toxicity.TOKEN.findall(sentence)
            if words:
                p += slow_marginals([model.word(w.lower()) for w in words], model.trans)
        evidence = model.evidence(np.array(p), [len(p)])
        assert math.isclose(got[i].score, float(model.score(evidence)[0]), rel_tol=1e-6)
        assert sum(1 for x in p if x >= 0.5) == sum(len(toxicity.TOKEN.findall((text or "")[s.start : s.end])) for s in got[i].spans)


def slow_marginals(s, trans):
    def add(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    clip = lambda x: min(30.0, max(-30.0, x))
    f, b = [(0.0, clip(s[0]))], [(0.0, 0.0)]
    for x in s[1:]:
        f.append(tuple(add(f[-1][0] + trans[0, y], f[-1][1] + trans[1, y]) + y * clip(x) for y in (0, 1)))
    for x in s[:0:-1]:
        b.append(tuple(add(trans[y, 0] + b[-1][0], trans[y, 1] + clip(x) + b[-1][1]) for y in (0, 1)))
    return [1 / (1 + math.exp((f0 + b0) - (f1 + b1))) for (f0, f1), (b0, b1) in zip(f, b[::-1], strict=True)]


def test_chunks_carry_messages_exactly():
    rng = np.random.default_rng(5)
    lengths = [3, 1, 700, 0, 256, 257, 1500]
    s, trans = rng.normal(0, 2, sum(lengths)), rng.normal(size=(2, 2))
    whole = crf.marginals(s, trans, crf.Steps(lengths, 10**9))
    for chunk in (1, 7, 256):
        assert np.allclose(crf.marginals(s, trans, crf.Steps(lengths, chunk)), whole, atol=1e-12)


def test_toxicity_learns_from_repeated_ids_once(spark, tmp_path, monkeypatch):
    fixture(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, odds: seen.append((texts, labels)))
    toxicity.train(docs, labels)
    toxicity.train(docs.union(docs).union(docs), labels.union(labels))
    assert sorted(zip(*seen[0], strict=True)) == sorted(zip(*seen[1], strict=True)) and len(seen[0][0]) == 240


def test_toxicity_sample_skips_what_does_not_fit(spark, tmp_path, monkeypatch):
    fixture(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    first = [r.doc_id for r in labels.orderBy(F.xxhash64(F.lit(11), "doc_id")).limit(3).collect()]
    text = F.when(F.col("doc_id").isin(first), F.repeat(F.concat("text", F.lit(" ")), 400)).otherwise(F.col("text"))
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", {1: 4_000, 0: 8_000})
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, odds: seen.append((texts, labels)))
    toxicity.train(docs.withColumn("text", text), labels)
    size = Counter()
    for t, y in zip(*seen[0], strict=True):
        size[y] += len(t)
        assert len(t) < 4_000
    assert 3_500 < size[1] <= 4_000 and 7_500 < size[0] <= 8_000


# ---- the pipeline's stages


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    rows = [(1, None, None, None, None), (None, "x y z", "en", "a", 1), (None, "x y z", "en", "a", 1), (2, "lorem " * 60_000, "en", "a", 1), (3, "Calm words of a clean text.", "en", "b", 5), (3, "Calm words of a clean text.", "en", "b", 5)]
    odd = spark.createDataFrame(rows, DOC)
    clash = odd.select("*", *[F.lit("clash").alias(c) for c in ("score", "spans", "copy", "shuffle_key", "node", "root", "_text_node", "ids", "_scored", "fp")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
        out = stage(spark, clash, str(tmp_path))
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS, name
        kept = Counter(r.doc_id for r in out.collect())
        if name == "toxicity":
            assert kept == Counter({1: 1, None: 2, 2: 1, 3: 2})
        elif name == "simhash_near_dedup":
            assert kept == Counter({1: 1, None: 1, 2: 1, 3: 1})
        elif name == "bpe":
            assert kept == Counter({1: 1, None: 2, 2: 1, 3: 2})
