"""Nearest neighbours against brute force; HTML extraction on labelled and odd pages; the field against enumeration."""

import itertools
import math

import numpy as np
import pytest

from plumbline.llm import crf, html_text, neighbours


def test_field_equals_enumeration():
    rng = np.random.default_rng(1)
    s, trans = rng.normal(size=6), rng.normal(size=(2, 2))
    total, ones, best = 0.0, np.zeros(6), (-1e9, None)
    for y in itertools.product((0, 1), repeat=6):
        score = sum(s[t] * y[t] for t in range(6)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        total += math.exp(score)
        ones += np.array(y) * math.exp(score)
        best = max(best, (score, y))
    assert np.allclose(crf.marginals(s, trans, crf.Steps([6])), ones / total)
    assert crf.viterbi(s, trans) == list(best[1])
    both = crf.marginals(np.concatenate([s[:2], s]), trans, crf.Steps([2, 6]))
    assert np.allclose(both[2:], ones / total)


def brute(rows, queries, k=10):
    out = {}
    for q in queries:
        own = rows[q]
        dist = sorted((math.dist(own, v), i) for i, v in rows.items() if i != q)
        out[q] = [i for _, i in dist[:k]]
    return out


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    rows = {i: rng.normal(size=16).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = neighbours.search(df, "vec_id % 100 = 0").collect()
    want = brute(rows, range(0, 3000, 100))
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits / 300 >= 0.9
    for r in got:
        assert abs(r.score - math.dist(rows[r.query_id], rows[r.vec_id])) < 1e-12 and r.query_id != r.vec_id
    assert sorted(r["rank"] for r in got if r.query_id == 0) == list(range(1, 11))


def test_neighbours_whole_probe_is_exact_and_copies_tie_by_id(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=8).tolist() for i in range(400)}
    rows |= {i: [1.0] * 8 for i in range(500, 700)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = neighbours.search(df, "vec_id % 100 = 0", coverage=1.0, rerank=1000).collect()
    want = brute(rows, [i for i in rows if i % 100 == 0])
    for q, ids in want.items():
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == ids


def test_neighbours_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0, 1.0]), (6, [0.0, 2.0]), (None, [1.0, 2.0]), (7, []), (6, [0.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, rank int")
    got = neighbours.search(df, "vec_id % 100 = 0").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 6, math.sqrt(5))]
    assert neighbours.search(df.limit(0), "vec_id % 100 = 0").count() == 0


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.labelled_pages())


def test_html_labelled_pages(model):
    pages = list(html_text.labelled_pages(120, seed=77))
    right = sum(model(p) == "\n\n".join(t for t, y in known if y) for p, known in pages)
    assert right / len(pages) > 0.9


def test_html_odd_markup(model):
    page = """<html><head><title>no</title><script>if (a < b) x("</p>")</script></head><body><nav><a href=x>Menu</a> <a href=y>Other</a></nav>
    <article><h1>A &amp; B &lt;c&gt;</h1><p><b>First,&nbsp;  text\n of it.<br>More of it.<p>Second <a href="q">linked</a> text, with words.<!-- <p>no</p> --></p></article>
    <footer>&copy; somebody 2020</footer>"""
    assert model(page) == "A & B <c>\n\nFirst, text of it. More of it.\n\nSecond linked text, with words."
    assert model("") == "" and model("<p></p>") == ""


def test_html_cases(spark, model):
    df = spark.createDataFrame([(1, None, "kept"), (2, "", "kept"), (3, "<article><p>Some words are here, and there.</p></article>", "kept")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df, model=model).collect()}
    assert got == {1: "", 2: "", 3: "Some words are here, and there."}
    assert html_text.extract(df.limit(0), model=model).count() == 0
