"""What the contracts say at their edges: character classes of the library, copies and sizes of vectors, lengths only."""

import math

import numpy as np
import pytest

from plumbline.llm import bpe, neighbours, token_counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_every_code_point_is_split_as_the_library_does(library):
    encoder = bpe.Encoder(bpe.compile_file(bpe.default_path()))
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{chr(c)}'s{chr(c)}7 {chr(c)} a" for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    for part in range(0, len(texts), 20):
        want = library.encode_batch(texts[part : part + 20], add_special_tokens=False)
        for text, own in zip(texts[part : part + 20], want, strict=True):
            assert np.frombuffer(encoder([text])[0], np.int32).tolist() == own.ids
    counts = token_counts.Counter(bpe.default_path())
    assert counts(texts[:40]) == [len(x.ids) for x in library.encode_batch(texts[:40], add_special_tokens=False)]


def test_lengths_equal_the_encoding_and_texts_stay_away(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = token_counts.count_tokens(docs.select("doc_id", "text", "source"))
    assert counted.columns == ["doc_id", "source", "n_tokens"]
    encoded = {r.doc_id: r.n_tokens for r in bpe.digest(docs).collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.report(docs).collect()} == encoded and len(encoded) > 100


def wanted(rows, queries, k=10):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    out = {}
    for q in queries:
        with np.errstate(over="ignore"):
            d = np.sqrt(((x - np.array(rows[q])) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[q] = [int(ids[i]) for i in order if ids[i] != q][:k]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows.items()], "vec_id long, embedding array<double>")
    out = {}
    for r in neighbours.search(df, "vec_id % 100 = 0", **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_copies_come_by_id(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(40, 16))
    at = rng.permutation(np.repeat(np.arange(40), 100))
    rows = {i: points[p] for i, p in enumerate(at)}
    for block in (4096, 300):
        got = found(spark, rows, block=block)
        want = wanted(rows, range(0, 4000, 100))
        assert {q: [i for i, _ in x] for q, x in got.items()} == want and all(s == 0.0 for x in got.values() for _, s in x)


@pytest.mark.parametrize("change", ["one huge", "tiny", "huge", "one tiny"])
def test_sizes_of_vectors_do_not_matter(spark, change):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 3
    rows = {i: centres[i % 20] + rng.normal(size=16) for i in range(4000)}
    if change == "one huge":
        rows[77] = np.full(16, 1e39)
        rows[100] = np.full(16, -1e200)
    if change == "one tiny":
        rows[77] = np.full(16, 1e-300)
    rows = {i: x * {"tiny": 1e-25, "huge": 1e30}.get(change, 1.0) for i, x in rows.items()}
    got, want = found(spark, rows), wanted(rows, range(0, 4000, 100))
    assert recall(got, {q: w for q, w in want.items() if q != 100}) >= 0.9
    q, x = 200, got[200]
    assert all(math.isclose(s, math.dist(rows[q], rows[i]), rel_tol=1e-12) for i, s in x)


def test_distances_beyond_squares():
    a, b = np.array([[3e200, 0.0], [3e-200, 0.0], [1.0, 1.0], [1e308, 0.0]]), np.array([[0.0, 4e200], [0.0, 4e-200], [1.0, 1.0], [-5e307, 0.0]])
    assert np.allclose(neighbours.distances(a, b) / np.array([5e200, 5e-200, 1.0, 1.5e308]), [1, 1, 0, 1])
