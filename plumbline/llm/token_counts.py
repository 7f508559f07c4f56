"""Token counts (operator 6): batch encoding in Arrow functions that return lengths only.

Batches hold about the same number of bytes, however long their texts are. A text longer than a piece is split
where the pre-split pattern always begins a new word - before a space between two signs, and between a letter of any
script and a sign that is neither letter, digit nor space - but not inside special strings, so the pieces' counts add
up to the whole text's. Special strings inside texts count as the one token they stand for, which is
the tokenizers library's default.

The vocabulary is read from the tokenizers JSON file. Where its token ids are its merge order (checked when it is
loaded) the tiktoken engine counts, about five times as fast as the tokenizers library and with equal ids; else,
and for pieces without a safe boundary, the tokenizers library does.

Cases: a null text counts as empty (0 bytes, 0 tokens); texts of any length are counted whole; a null id stays null;
repeated rows give repeated rows;
an empty table gives an empty table; other columns but the text pass through and results replace columns of the same
name.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import PATTERN, byte_letters, default_path
from plumbline.llm.common import byte_chunks, clean_text, table

#: Characters of a piece, at least, before a safe boundary is looked for.
PIECE = 50_000
#: Longer pieces (texts without a safe boundary) go to the tokenizers library.
UNSAFE = 400_000
#: Bytes of a batch.
BATCH_BYTES = 1_000_000

BOUNDARY = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}\p{N}])")


def pieces(text: str, size: int = PIECE, special: Iterable[str] = ()) -> list[str]:
    """Consecutive parts of the text, cut at safe boundaries only."""
    out, start, at = [], 0, size
    while len(text) - start > size and (m := BOUNDARY.search(text, at)):
        cut = m.start()
        if any(x in text[max(0, cut - len(x) + 1) : cut + len(x) - 1] for x in special):
            at = cut + 1
            continue
        out.append(text[start:cut])
        start, at = cut, cut + size
    return [*out, text[start:]]


class Counter:
    """Counts the tokens of texts in a Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        vocab, letters = file["model"].get("vocab", {}), byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"].get("merges", [])]
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.special = list(special)
        plain = {t: i for t, i in vocab.items() if t not in special}
        pre = file.get("pre_tokenizer") or {}
        by_rank = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(plain) == 256 + len(merges)
        strict = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in file["added_tokens"])
        if by_rank and not strict and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not file.get("normalizer"):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in plain.items()}
            self.fast = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _count(self, batch: list[str]) -> list[int]:
        if self.fast is None:
            return [len(x) for x in self.slow.encode_batch(batch, add_special_tokens=False)]
        return [len(self.fast.encode(t, allowed_special="all")) if len(t) <= UNSAFE else len(self.slow.encode(t, add_special_tokens=False)) for t in batch]

    def __call__(self, texts: list[str]) -> list[int]:
        split = [pieces(t, PIECE, self.special) if len(t) > PIECE else [t] for t in texts] if self.fast else [[t] for t in texts]
        flat = [p for x in split for p in x]
        counts: list[int] = []
        for part in byte_chunks((len(p) if p.isascii() else len(p.encode()) for p in flat), BATCH_BYTES):
            counts += self._count(flat[part])
        out, at = [], 0
        for x in split:
            out.append(sum(counts[at : at + len(x)]))
            at += len(x)
        return out


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df without `text`, with its number of tokens: texts go to Python, lengths come back."""
    path = path or default_path()
    rest = [c for c in df.columns if c not in (text, out)]
    df = df.select(*[F.col(f"`{c}`") for c in rest], clean_text(F.col(f"`{text}`")).alias(text))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(out, T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        for batch in it:
            counts = _counters[path](batch.column(len(rest)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*rest, out])

    return df.mapInArrow(batches, schema)


def report(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens exceed the limit."""
    text = clean_text("text")
    counted = count_tokens(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")), path=path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
