"""The pipeline's near-copy stage against brute force over five-word shingles."""

import random

import corpus_pipeline
from plumbline import shared
from plumbline.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def smallest_of_groups(rows):
    root = {i: i for i, _ in rows}
    changed = True
    near = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if similarity(x, y) >= 0.8]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {i for i, r in root.items() if r == i}


def planted():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(60, 300)))) for i in range(60)]
    seen = []
    for i in range(60):
        own = rows[i][1].split()
        for at in rng.sample(range(len(own)), max(1, len(own) * rng.choice([1, 2, 3, 6]) // 100)):
            own[at] = "other" + str(rng.randrange(1000))
        rows.append((100 + i, " ".join(own)))
        seen.append(similarity(rows[i][1], rows[-1][1]))
    assert sum(0.8 <= s < 0.95 for s in seen) >= 20 and sum(s < 0.8 for s in seen) >= 5
    return [*rows, (300, None), (301, ""), (302, "two words"), (303, "Two  WORDS"), (304, "two others")]


def test_stage_drops_planted_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(smallest_of_groups(rows))
    assert all(r.text == dict(rows)[r.doc_id] for r in kept)


def test_blocks_lose_no_link(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # a chain: each text changes a word of the one before
        base = [*base]
        base[(i * 5) % 200] = f"x{i}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    led = near_copies.components(spark, near_copies.links(df, block=4))
    assert led.count() == 39 and led.select("root").distinct().count() == 1
    assert near_copies.deduplicate(df.limit(0)).count() == 0


def test_ids_that_repeat_or_lack_lose_no_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (None, c), (None, c), (9, d), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in near_copies.deduplicate(df).collect()]
    assert sorted(kept, key=lambda r: r[1]) == [(1, a), (5, b), (None, c), (9, d)]


def test_blocks_by_bytes_lose_no_link(spark, monkeypatch):
    """Large copies of large texts: groups in Python stay below two blocks of bytes, and every link is found."""
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", 20_000)
    rng = random.Random(11)
    words = ["w" + str(i) for i in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(1_200)) for _ in range(2)]
    rows = [(i, base[i % 2] + f" end {i}") for i in range(40)] + [(100, "short text"), (101, base[0])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id for r in near_copies.deduplicate(df).collect()}
    assert got == smallest_of_groups(rows)


def test_memory_of_a_group_of_long_texts():
    """Two blocks of 16 MB of text: 32 texts of 1 MB."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(12)
    base = np.unique(rng.integers(0, 2**63, 170_000, np.uint64))
    sets = [np.unique(np.concatenate([base[i * 500 :], rng.integers(0, 2**63, 400, np.uint64)])) for i in range(32)]
    tracemalloc.start()
    links = near_copies.spanning([f"n{i}" for i in range(32)], sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == 31 and peak < 600e6


def test_texts_move_once_and_intermediate_tables_go(spark):
    """The pipeline's disk: the join that picks the candidates' texts moved all texts again where names are too many to
    broadcast, and the stage's tables stayed beside the next stage's."""
    import os

    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, once = near_copies.candidates(df.select(near_copies.node("text").alias("node"), near_copies.clean_text("text").alias("text")), 5)
        picked = once.join(pairs.select("a"), once["node"] == pairs["a"], "left_semi")
        plan = picked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        wanted = {r.a for r in pairs.collect()}
        assert {r.node for r in picked.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    folder = shared.shared_dir(spark).removeprefix("file:")
    before, tables = set(os.listdir(folder)), spark.catalog.listTables()
    kept = near_copies.deduplicate(df)
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"first"}
    assert spark.catalog.listTables() == tables
    assert {r.doc_id for r in kept.collect()} == smallest_of_groups(rows)
