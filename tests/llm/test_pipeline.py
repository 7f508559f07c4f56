"""The pipeline against a brute-force version of its stages, on a small fixture."""

import random

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import bpe, toxicity
from test_operators import brute_components, brute_fingerprint


def fixture(spark, path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        own = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(6):
                own[rng.randrange(len(own))] = rng.choice(["vilewordx", "nastyxx"])
        docs.append((i, " ".join(own) + ".", "en", f"src{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "src0", 1) for i in (1, 2, 3)] + [(2000, None, "en", None, 1), (2001, "", None, "src1", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_pipeline(spark, tmp_path):
    docs = fixture(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [d for d in docs if not (d[1] and ("vilewordx" in d[1] or "nastyxx" in d[1]))]
    root = brute_components([(d[0], brute_fingerprint(d[1])) for d in left], 3)
    left = {d[0]: d for d in left if root[d[0]] == d[0]}
    assert 1001 not in left and 2001 not in left and 2000 in left
    assert {r.doc_id for r in got} <= set(left)
    # copies: the inverse Poisson distribution, summed by hand
    import hashlib
    import math
    from collections import Counter

    counts = Counter(d[3] for d in left.values())
    want = Counter()
    for i, d in left.items():
        rate = len(left) / (counts[d[3]] * len(counts))
        parts = math.ceil(rate / 32)
        k = 0
        for part in range(parts):
            u = int(hashlib.md5(f"7|{i}|{part}".encode()).hexdigest()[:13], 16) / 2**52
            n, upto = 0, math.exp(-rate / parts)
            while upto <= u:
                n += 1
                upto += math.exp(-rate / parts) * (rate / parts) ** n / math.factorial(n)
            k += n
        if k:
            want[i] = k
    assert Counter(r.doc_id for r in got) == want
    encoder = bpe.Encoder(bpe.compile_file(bpe.default_path()))
    for r in got:
        assert r.ids == np.frombuffer(encoder([left[r.doc_id][1] or ""])[0], np.int32).tolist()
        assert r.n_tokens == len(r.ids) and r.round_trip in (True, None)


def test_toxicity_learns_tags_and_keeps_clean_rows(spark, tmp_path):
    docs = fixture(spark, str(tmp_path))
    rows = {r.doc_id: r for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs)
    for i, text, *_ in docs:
        bad = bool(text) and ("vilewordx" in text or "nastyxx" in text)
        assert rows[i].predicted == int(bad) and 0 <= rows[i].score <= 1
        hit = [text[s.start : s.end] for s in rows[i].spans]
        assert bool(hit) == bad and all("vilewordx" in h or "nastyxx" in h for h in hit)
    assert rows[2000].score == rows[2001].score


def test_toxicity_without_labels(spark):
    model = toxicity.fit(["a", "b"], [0, 0])
    df = spark.createDataFrame([(1, "x y", 5), (None, None, 6)], "doc_id long, text string, score int")
    assert [r.score for r in toxicity.tag(df, model).collect()] == [0.0, 0.0]
    assert toxicity.tag(df.limit(0), model).count() == 0


def test_toxicity_skips_long_documents_only(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = fixture(spark, str(tmp_path))
    frame, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    first = labels.orderBy(F.xxhash64(F.lit(11), "doc_id")).first().doc_id
    text = F.when(F.col("doc_id") == first, F.repeat(F.concat("lang", F.lit(" ")), 8_100_000)).otherwise(F.col("text"))
    model = toxicity.train(frame.withColumn("text", text), labels)
    assert model.fitted
    rows = {r.doc_id: r.score for r in toxicity.tag(frame.filter(F.col("doc_id") < 240), model).collect()}
    assert all((rows[i] >= 0.5) == ("vilewordx" in t or "nastyxx" in t) for i, t, *_ in docs[:240])
    text = F.when(F.col("doc_id") % 4 == 0, F.repeat(F.concat("lang", F.lit(" ")), 70_000)).otherwise(F.col("text"))
    with pytest.raises(ValueError, match="one kind"):
        toxicity.train(frame.withColumn("text", text), labels)
