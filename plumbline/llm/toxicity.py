"""Toxicity by a linear-chain conditional random field (operator 8).

Train.  A bounded sample of labelled documents is read: ids and lengths first, in the order of a hash of the id; a document
that does not fit (`DOC_CHARS`, `SAMPLE_CHARS`) is skipped and the next ones are taken, up to `SAMPLE` of each label. A feature
is a word, or its first 3 to 6 or last 3 to 5 letters; features that documents labelled toxic hold far more often than
others mark the labelled tokens inside toxic documents. The field learns token labels from these features and from
the neighbour's label, sentence by sentence.

Score.  Forward-backward gives each token's marginal probability. Neighbouring tokens of 0.5 and more form an
offending span (character offsets). A document's score is a logistic function of its largest marginal, the sum of
its marginals and their share of its tokens, fitted on the sample's documents with their document labels.

Only texts go into a score. Weights are of bounded size (features of the sample) and broadcast.

Cases: null and empty texts have no tokens, the score of no evidence, and no spans; texts of any length are scored
whole, and sentences of any length are one chain; offsets are those of the text as it is, also where lower-casing would
change its length; a null id stays null; equal texts have equal scores; an id that occurs more than once is learnt from
once (its shortest text, label 1 where its labels differ); without labelled rows of both kinds every score is 0; an
empty table gives an empty table; other columns pass through, results replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import crf
from plumbline.llm.common import byte_chunks, clean_text, table, written

#: Labelled documents of each label that the field is fitted on, at most.
SAMPLE = {1: 1500, 0: 3000}
#: Characters of the sample of each label, at most; documents that do not fit are skipped.
SAMPLE_CHARS = {1: 8_000_000, 0: 16_000_000}
#: Characters of a document of the sample, at most; longer ones are only scored.
DOC_CHARS = 200_000
#: Words kept with their scores in each Python worker.
CACHE_WORDS = 400_000
#: Rows whose ids and lengths are looked at for each one wanted.
LOOKED_AT = 4
CHUNK_BYTES = 1_000_000

TOKEN = re.compile(r"\w+|[.!?\n]")
ENDS = {".", "!", "?", "\n"}
#: Log odds (toxic against other documents) from which a feature marks tokens, and documents it must be in.
MARK, LEAST = 2.5, 3
#: Hashes of features; two features rarely share one.
BUCKETS = 1 << 22
#: Positions of a training chunk, about.
TRAIN_CHUNK = 200_000


def word_features(word: str) -> list[int]:
    """The features of a lower-case word, as hashes below BUCKETS."""
    n = len(word)
    texts = [word, *("^" + word[:k] for k in range(3, min(n, 6) + 1)), *(word[-k:] + "$" for k in range(3, min(n, 5) + 1))]
    return [crc32(t.encode()) % BUCKETS for t in texts]


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(4))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(3))
    spread: np.ndarray = field(default_factory=lambda: np.ones(3))
    fitted: bool = False

    def word(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in word_features(word))

    def evidence(self, p: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Largest marginal (as log odds), log of the sum, and share of each document's tokens."""
        out = np.zeros((len(lengths), 3))
        at = 0
        for i, n in enumerate(lengths):
            own = p[at : at + n]
            top = min(max(float(own.max()) if n else 0.0, 1e-6), 1 - 1e-6)
            total = float(own.sum())
            out[i] = math.log(top / (1 - top)), math.log(total + 0.01), math.sqrt(total / n) if n else 0.0
            at += n
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(evidence))
        x = self.doc[0] + ((evidence - self.mean) / self.spread) @ self.doc[1:]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sequences(tokens: list[str]) -> list[int]:
    """Lengths of the token runs between sentence ends (which are in no run)."""
    out, n = [], 0
    for t in tokens:
        if t in ENDS:
            if n:
                out.append(n)
            n = 0
        else:
            n += 1
    return [*out, n] if n else out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, l2: float = 1e-3) -> np.ndarray:
    """Weights (constant first) by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int], odds_of_one: float | None = None) -> Model:
    """The model of labelled documents; odds_of_one: how many rows have label 1 for each one with label 0, where the
    documents are a sample with other shares."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    words: dict[str, int] = {}
    items, lengths = [], []
    for t in texts:
        tokens = TOKEN.findall(t)
        items.append(np.array([words.setdefault(w.lower(), len(words)) for w in tokens if w not in ENDS], np.int32))
        lengths.append(sequences(tokens))
    raw, sizes = array("I"), array("I")
    for w in words:
        own = word_features(w)
        raw.extend(own)
        sizes.append(len(own))
    raw, sizes = np.array(raw, np.int64), np.array(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    in_docs = np.zeros((2, BUCKETS), np.int32)
    for own, label in zip(items, labels, strict=True):
        unique = np.unique(own)
        n = sizes[unique]
        at = np.repeat(starts[unique] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        in_docs[label, np.unique(raw[at])] += 1
    # features of fewer than LEAST documents say nothing; the rest are numbered from 1, 0 is the bias
    kept = np.flatnonzero(in_docs.sum(axis=0) >= LEAST)
    number = np.zeros(BUCKETS, np.int32)
    number[kept] = np.arange(1, len(kept) + 1)
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((in_docs[1] + 0.5) / (n1 + 1)) - np.log((in_docs[0] + 0.5) / (n0 + 1))
    odds[in_docs[1] < LEAST] = 0
    marked = np.maximum.reduceat(odds[raw], starts) >= MARK if len(raw) else np.zeros(0, bool)
    del odds, in_docs
    ids = number[raw]
    owner = np.repeat(np.arange(len(sizes)), sizes)[ids > 0]
    sizes = np.bincount(owner, minlength=len(sizes)) + 1
    flat = np.zeros(sizes.sum(), np.int64)
    flat[np.setdiff1d(np.arange(len(flat)), np.cumsum(sizes) - sizes, assume_unique=True)] = ids[ids > 0]
    del raw, number, ids, owner
    chunks, part = [], []
    for i in range(len(items)):
        part.append(i)
        if sum(len(items[j]) for j in part) >= TRAIN_CHUNK or i == len(items) - 1:
            chunks.append((np.concatenate([items[j] for j in part]), np.concatenate([marked[items[j]] * labels[j] for j in part]), np.array([n for j in part for n in lengths[j]], np.int64)))
            part = []
    w, trans = crf.train(chunks, flat, sizes, len(kept) + 1, rounds=40)
    model = Model({int(f): float(x) for f, x in zip(kept.tolist(), w[1:].tolist(), strict=True) if abs(x) > 1e-3}, float(w[0]), trans)
    scores = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[flat], len(sizes))
    p = [crf.marginals(scores[own], trans, crf.Steps(n)) for own, n in zip(items, lengths, strict=True)]
    evidence = model.evidence(np.concatenate(p), [len(own) for own in items])
    model.mean, model.spread = evidence.mean(axis=0), evidence.std(axis=0) + 1e-6
    model.doc = logistic((evidence - model.mean) / model.spread, y)
    if odds_of_one:
        model.doc[0] += math.log(odds_of_one) - math.log(n1 / n0)
    model.fitted = True
    return model


def train(docs: DataFrame, labels: DataFrame, rows: str = "true", id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of a bounded sample of the labelled documents; rows: SQL over the label table, those to learn from."""
    known = labels.filter(rows).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    counts = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return Model()
    own = docs.select(F.col(id).alias("_id"), clean_text(text).alias("_text"))
    sizes = own.select("_id", F.struct(F.length("_text").alias("n"), F.xxhash64("_text").alias("h")).alias("t"))  # no text is shuffled
    each = sizes.join(known, "_id").groupBy("_id", "_label").agg(F.min("t").alias("t"))
    each = written(docs.sparkSession, each.select("_id", "_label", F.col("t.n").alias("n"), F.col("t.h").alias("h"), F.xxhash64(F.lit(11), "_id").alias("o")), "labelled")
    picked = [p for k, n in SAMPLE.items() for p in _fitting(each.filter((F.col("_label") == k) & (F.col("n") <= DOC_CHARS)), n, SAMPLE_CHARS[k])]
    if len({p[1] for p in picked}) < 2 <= each.select("_label").distinct().count():
        raise ValueError(f"no labelled document of one kind has {DOC_CHARS} characters or fewer: nothing to learn from")
    wanted = docs.sparkSession.createDataFrame(picked, T.StructType([each.schema["_id"], *(T.StructField(n, t) for n, t in (("_label", T.IntegerType()), ("_h", T.LongType()), ("_place", T.IntegerType())))]))
    found = own.join(F.broadcast(wanted), (own["_id"] == wanted["_id"]) & (F.xxhash64("_text") == F.col("_h")))  # SAMPLE rows at most
    found = found.groupBy("_place", "_label").agg(F.first("_text").alias("_text")).orderBy("_place").collect()
    return fit([r._text for r in found], [r._label for r in found], counts[1] / counts[0])


def _fitting(rows: DataFrame, most: int, chars: int) -> list[tuple]:
    """(id, label, text hash, place) of the first rows, in order of the hash, that fit: `most` rows, `chars` characters."""
    out, total = [], 0
    for r in rows.orderBy("o", "_id").limit(LOOKED_AT * most).collect():
        if len(out) < most and total + r.n <= chars:
            total += r.n
            out.append((r._id, r._label, r.h, len(out) + most * 10 * r._label))
    return out


def tag(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with `score`, `spans` (start, end, largest marginal; character offsets into the text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c not in ("score", "spans")]
    df = df.select(*[clean_text(c).alias(c) if c == text else F.col(f"`{c}`") for c in rest])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())])
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    at = rest.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in it:
            texts = batch.column(at).to_pylist()
            scores, spans = [], []
            for part in byte_chunks(pc.binary_length(batch.column(at)).to_pylist(), CHUNK_BYTES):
                a, b = tagger(texts[part])
                scores += a
                spans += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=schema.names)

    return df.mapInArrow(batches, schema)


class Tagger:
    """Scores texts in a Python worker; keeps words it has seen, within a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = dict.fromkeys(ENDS, math.nan)

    def __call__(self, texts: list[str]) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        known, model = self.known, self.model
        if len(known) > CACHE_WORDS:
            known.clear()
            known.update(dict.fromkeys(ENDS, math.nan))
        docs = [TOKEN.findall(t) for t in texts]
        for w in {w for x in docs for w in x if w not in known}:
            known[w] = model.word(w.lower())
        sizes = [len(x) for x in docs]
        s = np.fromiter((known[w] for x in docs for w in x), float, sum(sizes))
        owner = np.repeat(np.arange(len(docs)), sizes)
        word = ~np.isnan(s)
        # runs of words of one document between sentence ends
        cut = np.zeros(len(s), bool)
        cut[1:] = ~word[:-1] | (owner[1:] != owner[:-1])
        cut[:1] = True
        start = np.flatnonzero(cut & word)
        ends = np.append(np.flatnonzero(cut), len(s))
        stop = ends[np.searchsorted(ends, start, "right")]
        stop = stop - ~word[stop - 1]
        p = crf.marginals(s[word], model.trans, crf.Steps(stop - start)) if model.fitted else np.zeros(word.sum())
        counts = np.bincount(owner[word], minlength=len(docs)).tolist() if len(docs) else []
        scores = model.score(model.evidence(p, counts)).tolist()
        spans, at = [], 0
        for text, n in zip(texts, counts, strict=True):
            own = p[at : at + n]
            spans.append(self._spans(text, own) if n and own.max() >= 0.5 else [])
            at += n
        return scores, spans

    @staticmethod
    def _spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
        out, near, i = [], False, 0
        for m in TOKEN.finditer(text):
            if m[0] in ENDS:
                near = False
                continue
            x = float(p[i])
            i += 1
            if x < 0.5:
                near = False
            elif near:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], x))
            else:
                out.append((m.start(), m.end(), x))
                near = True
        return out


#: SQL: the row is held out, and labels of it are not learnt from.
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), f"not ({HELD_OUT})")
    scored = tag(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
