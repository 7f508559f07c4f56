"""Collocations, line dedup and source divergence against plain versions, with their defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import collocations, divergence, line_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], DOC)


# ---- op11


def phrases(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {g: a for g, a in own.items() if " " in g and a >= least}
        kept = []
        for g, a in found.items():
            w = g.split(" ")
            if len(w) == 2 and any(100 * b >= 50 * a and (h.startswith(f"{g} ") or h.endswith(f" {g}")) for h, b in found.items() if h.count(" ") == 2):
                continue
            cuts = [(10**6 * a * a // (own[" ".join(w[:k])] * own[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, g.encode(), g, a, own[" ".join(w[:k])], own[" ".join(w[k:])]))
        for rank, (score, _, _, g, a, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, g, a, left, right, n[lang], -score))
    return sorted(out)


def prose(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "é", "São", "x-1", "a", "ab"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", "\r\n"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 80)))
        rows.append((i, text, rng.choice(["en", None, "und", "fr"]), "s"))
    rows += [(1000 + i, "one two three four five six. one two; seven", "en", "s") for i in range(12)]  # a path
    rows += [(2000 + i, "ring of gold ring of gold ring of gold", "cy", "s") for i in range(15)]  # a cycle
    rows += [(3000 + i, "go go go go", "fr", "s") for i in range(11)] + [(4000, None, "en", "s"), (4001, "", None, None), (4002, "...", "en", "s")]
    return rows


def test_collocations_equal_counting(spark):
    rows = prose(1)
    df = docs(spark, rows)
    for top in (2000, 7):
        got = collocations.collocations(df, top=top).collect()
        assert sorted(map(tuple, got)) == phrases(rows, top=top)
    assert collocations.collocations(df.limit(0)).count() == 0
    few = collocations.collocations(df, least=3)
    assert sorted(map(tuple, few.collect())) == phrases(rows, least=3)


def test_collocations_in_small_chunks_and_parts(spark, monkeypatch):
    rows = [*prose(2, 40), (9, "long text with many many words, " * 3_000, "en", "s")]
    for name, value in (("CHUNK_BYTES", 900), ("CODED", 50), ("BUCKET_BYTES", 2_000), ("DEALT", 3)):
        monkeypatch.setattr(collocations, name, value)
    tokens = [t for d in collocations.chunks([(r[1] or "").encode() for r in rows]) for t in collocations.tokens_of(d).to_pylist()]
    assert len([t for t in tokens if t != collocations.END]) == sum(len(re.findall(r"[^ \t.,;:!?\n-\r]+", r[1] or "")) for r in rows)
    assert sorted(map(tuple, collocations.collocations(docs(spark, rows)).collect())) == phrases(rows)


def test_paths_hold_every_edge_once(spark):
    edges, nodes, words = collocations.graph(docs(spark, prose(3)))
    want = {(r.lang, r.gram): r.f for r in edges.collect()}
    for part in (512, 2):
        got, lengths = {}, []
        for r in collocations.compact(edges, part).collect():
            assert len(r.words) == len(r.counts) + 2
            lengths.append(len(r.counts))
            for i, f in enumerate(r.counts):
                assert (r.lang, " ".join(r.words[i : i + 3])) not in got
                got[r.lang, " ".join(r.words[i : i + 3])] = f
        assert got == want and max(lengths) <= part and max(lengths) > 1
    flow = Counter()
    for r in nodes.collect():
        flow[r.lang, r.gram] = r.f
    assert flow["cy", "ring of"] == 45 and {(r.lang, r.gram): r.f for r in words.collect()}["cy", "gold"] == 45


# ---- op12


def kept_lines(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    order = lambda i: (i is None, i)
    first = {}
    held = defaultdict(set)
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    first = {k: min(ids, key=order) for k, ids in held.items() if len(ids) > 1}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in first or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def lined(seed):
    rng = random.Random(seed)
    pool = ["Cookie policy of this site", "  cookie POLICY of this site\t", "All rights reserved.", "short", "éééééééééé", "ééééé", "\x0bAbcdefghij\x0c", "abcdefghij", "", " " * 20]
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {rng.random()}" for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(lines), "en", "s"))
    rows += [(None, "Cookie policy of this site\nonly here, twice", "en", "s"), (None, "only here, twice\nno id", "en", "s"), (7, "rows of one id are one document\nx", "en", "s"), (7, "rows of one id are one document", "en", "s")]
    rows += [(300, None, None, None), (301, "", "en", "s"), (302, "twice inside\ntwice inside", "en", "s"), (303, "q" * 200_000 + "\n" + "z" * 50, "en", "s"), (304, "q" * 200_000, "en", "s")]
    return rows


def test_lines_equal_a_plain_version(spark):
    rows = lined(1)
    df = docs(spark, rows).withColumnRenamed("n_chars", "n_lines")
    from pyspark.sql import functions as F

    for words in (None, 64):  # a filter of the least size, and one so full that all is suspected
        got = line_dedup.dedup_lines(df, words=words and line_dedup.SEGMENT)
        assert got.columns == ["doc_id", "lang", "source", "text", "n_lines", "n_dropped"]
        own = got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
        assert sorted(map(tuple, own), key=str) == kept_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_filters_merge_in_any_order():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(4)]
    parts[3][:500] = parts[0][:500]
    parts[2][:10] = parts[2][10:20]
    one = line_dedup.Filters(line_dedup.LEAST_WORDS)
    for p in parts:
        one.see(p)
    assert line_dedup.suspected(parts[0][:500], one.twice).all() and line_dedup.suspected(parts[2][:20], one.twice).all()
    assert line_dedup.suspected(parts[1], one.twice).mean() < 0.01


# ---- op13


def divergences(rows, least=30, top=50):
    occurs, documents = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        occurs[lang, source].update(words)
        documents[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for w, n in documents[lang].items() if n >= least)
        own = {s: occurs[lang, s] for x, s in groups if x == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)
        p = {}
        for s, c in [*own.items(), (None, whole)]:
            total = sum(c[w] for w in kept) + 5 * len(kept)
            p[s] = {w: 1 + 10**9 * (c[w] + 5) // total for w in kept}
        for s in own:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in own if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            above = sorted((p[None][w] - p[s][w], w.encode(), w) for w in kept if own[s][w] and p[s][w] > p[None][w])
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(above[:top], 1)]
    return sorted(out)


def sourced(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeé" for b in "stuvwxyz"]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 else f"s{rng.randint(0, 9)}"
        own = words[hash_of(source) % 7 :: 2]
        rows.append((i, " ".join(rng.choice(own).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 30))) + " 12,don't", rng.choice(["en", "fr"]), source))
    return rows + [(900, None, None, None), (901, "a b", "xx", "one"), (902, "", "xx", "two"), (903, "123 --", "en", "empty"), (904, "as as as", "en", None)]


def hash_of(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:6], 16)


@pytest.mark.parametrize("options", [{}, {"block": 5, "tile": 3}, {"top": 2, "least": 60}])
def test_divergence_equals_a_plain_version(spark, options):
    rows = sourced(1)
    got = divergence.audit(docs(spark, rows), **options)
    assert sorted(map(tuple, got.collect())) == divergences(rows, options.get("least", 30), options.get("top", 50))


def test_divergence_of_nothing(spark):
    assert divergence.audit(docs(spark, []).limit(0)).count() == 0
    lone = [(i, "word", "en", "only") for i in range(40)]
    assert sorted(map(tuple, divergence.audit(docs(spark, lone)).collect())) == divergences(lone) == []


def test_shares_are_exact_beyond_64_bits():
    counts, total = np.array([5, 10**12 + 7, 9 * 10**14]), 9 * 10**15 - 1
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * int(c) // total for c in counts]
