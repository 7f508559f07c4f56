"""The operators against brute force, round trips, and their defined cases."""

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import bpe, licences, media, mixing, sharding, simhash, token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "a", "x" * 3000, "<|endoftext|> tail <|endoftext|>", "日本語 テスト 😀", "the cat sat", "\x00\x01 z", "word " * 4000]


def odd_docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(None, "a null id", None, None, None), (3, "a", "en", "s", 1)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark, library):
    import hashlib

    got = bpe.digest(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "a null id" if r.doc_id is None else (ODD[r.doc_id] or "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_small_vocabulary_is_greedy_by_rank():
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("ab", "ab"), ("b", "b"), ("ba", "aa")]
    ids = {t: i for i, t in enumerate(["a", "b", *("".join(m) for m in merges)])}
    automaton = bpe.Automaton({i: t.encode() for t, i in ids.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in merges], {})

    def by_merging(word):
        parts = list(word)
        for a, b in merges:
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [a, b]:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(ids[p] for p in parts)

    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    got = automaton.encode([w.encode() for w in words])
    assert [tuple(np.frombuffer(x, np.int32).tolist()) for x in got] == [by_merging(w) for w in words]


def test_bpe_keeps_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "kept")], "ids long, text string, other string")
    row = bpe.decode(bpe.encode(df)).first()
    assert (row.text, row.other, row.decoded) == ("a b", "kept", "a b") and row.ids
    assert bpe.digest(spark.createDataFrame([], DOC)).count() == 0


def test_token_counts_equal_the_library(spark, library):
    got = token_counts.report(odd_docs(spark), limit=3).collect()
    for r in got:
        text = "a null id" if r.doc_id is None else (ODD[r.doc_id] or "")
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 3)
    assert token_counts.report(spark.createDataFrame([], DOC)).count() == 0


def test_pieces_are_the_text_and_cut_where_words_begin():
    text = "ab cd. ef gh " * 500
    parts = token_counts.pieces(text, 100)
    assert "".join(parts) == text and len(parts) > 10
    assert all(p[0] in " ." for p in parts[1:])


def test_golay_words_two_bits_apart_share_a_codeword():
    tables = simhash.golay_tables()
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(23)
        y = x ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23))
        a, b = (set(simhash.golay_indices(np.array([v]), tables)[0].tolist()) - {-1} for v in (x, y))
        assert a & b and len(a) in (1, 6)


def brute_components(fps, bits):
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if bin(x ^ y).count("1") <= bits:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i, _ in fps}


def brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words).upper()
            texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate([*texts, *ODD])]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(fps, 3)
    for i, fp in fps:
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == want[i]


def test_simhash_blocks_lose_no_link(spark):
    rng = random.Random(4)
    fps, x = [], rng.getrandbits(64)
    for _ in range(300):  # chains within one dense neighbourhood
        fps.append(x)
        x ^= 1 << rng.randrange(20)
    fps = list({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (8, 2048):
        edges = simhash.links(df, 3, block)
        nodes = {r.node: r.root for r in simhash.components(spark, edges).collect()}
        want = brute_components([(f, f & (1 << 64) - 1) for f in fps], 3)
        groups = {}
        for f in fps:
            groups.setdefault(want[f], set()).add(f)
        for g in groups.values():
            assert {nodes.get(f, f) for f in g} == {min(g)}


def test_simhash_null_ids_and_empty(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "lonely words here now")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing_reaches_the_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "case when id % 10 < 7 then 'a' when id % 10 < 9 then 'b' else null end as source", "'x' as copy")
    got = {r.source: r["count"] for r in mixing.mix(df, {"a": 1.0, "b": 2.0, None: 1.0}).groupBy("source").count().collect()}
    for source, share in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        assert abs(got[source] / 20_000 - share) < 0.02
    assert {r.source for r in mixing.mix(df, {"a": 1.0, "b": 0.0, "zz": 5.0}).select("source").distinct().collect()} == {"a"}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_is_poisson(spark):
    import math

    df = spark.range(20_000).selectExpr("id as doc_id", "'a' as source")
    copies = {r.n: r.docs for r in mixing.mix(df).groupBy("doc_id").count().groupBy("count").count().toDF("n", "docs").collect()}
    for k in (1, 2, 3):
        assert abs(copies[k] / 20_000 - math.exp(-1) / math.factorial(k)) < 0.012


def test_sharding_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.fill(shards, 251)
    sizes = [table.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.fill(shards[:-1], 251)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.35 * 251
    with pytest.raises(ValueError):
        sharding.fill(shards, 250)


def test_sharding_places_by_the_table(spark):
    import hashlib

    df = spark.createDataFrame([(i, "x") for i in [*range(200), None, 3]], "doc_id long, shard string")
    table = sharding.fill(sharding.SHARDS)
    for r in sharding.place(df, "doc_id").collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])


def test_licences(spark):
    rows = [
        (1, "Text. Released under the MIT License. More; text\nLicensed under the Apache License, Version 2.0."),
        (2, "Permission is hereby granted.\nAll rights reserved."),
        (3, None),
        (4, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].licences == ["MIT", "Apache-2.0"]
    assert (got[2].licences, got[2].unmatched) == ([], ["xr"])
    assert got[3].sentence_codes == []
    assert got[4].sentence_codes[-1:] == ["pb"]


def test_media_round_trip_and_resync():
    rng = random.Random(5)
    for n in (0, 1, 64, 936, 937, 938, 5000):
        payload = bytes(rng.randrange(256) for _ in range(n))
        stream = media.write_stream(payload)
        got = media.read_stream(stream)
        assert got["payload"] == payload and got["crc_bad"] == 0 and got["skipped"] == 0
        assert got["frames"] == got["vbr_frames"] == -(-n // 937)
        assert got["samples"] == 1152 * got["frames"]
        assert all(stream[o : o + 2] == b"\xff\xfa" for o in got["offsets"])
    cut = stream[got["offsets"][1] - 100 :]  # starts inside a frame
    again = media.read_stream(cut)
    assert again["frames"] == got["frames"] - 1 and again["skipped"] == 100
    broken = bytearray(stream)
    broken[got["offsets"][2] + 10] ^= 1
    assert media.read_stream(bytes(broken))["crc_bad"] == 1
    assert media.read_stream(b"")["frames"] == 0


def test_media_query(spark, tmp_path):
    import hashlib

    docs = odd_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for r in media.op5_media(spark, str(tmp_path)).collect():
        raw = ("a null id" if r.doc_id is None else (ODD[r.doc_id] or "")).encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.media_sha256 == hashlib.sha256(media.write_stream(padded)).hexdigest() and "crc_bad=0" in r.feature


def test_simhash_refuses_more_bits_than_its_keys_cover(spark):
    with pytest.raises(ValueError, match="up to 3"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), bits=4)
