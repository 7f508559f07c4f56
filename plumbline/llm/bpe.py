"""Byte pair encoding and decoding by a tokenization automaton (operator 1).

Compile.  The automaton reads token sequences. It starts as one state with an arc for every byte. For each
merge u + v -> w, in rank order, a merge gadget is built: the state that u leads to is copied without its
v arc, u is led to the copy, and every state that had the path u, v gets an arc w to where v led before.
What remains accepts one token sequence for each byte string: the one that applying the merges gives.
A state depends on the last token only, and each copy differs from its origin by one arc, which takes with it
the tokens that later merges build with it on their left. In preorder of the tree "left part of" these are
neighbours, so a state's missing arcs are a sorted list of intervals. All states' lists, end to end, are the
transition table.

Words.  Texts are pre-split by the tokenizer's pattern. What a letter, a digit and a space is, is asked from the library
for every code point when the vocabulary is compiled, as its Unicode tables and those of Python's `regex` differ.

Encode.  Words are read left to right. A byte trie lists the tokens
that start at each position; the transition table says which of them the state there has an arc for. Exactly
one token arrives at every position, so the walk is deterministic and its work is linear in the word's length.

Decode.  The arc labels (token bytes) are joined; bytes that are no UTF-8 become U+FFFD.

Cases: a null text is an empty text, which has no tokens; a null id stays null; rows are never merged, so
repeated rows give repeated results; an empty table gives an empty table; columns other than the text pass
through, and results replace columns of the same name. Long texts are one row of work, in bounded chunks.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import byte_chunks, clean_text, table

#: The byte-level pre-split pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What of the pattern depends on Unicode tables.
CLASSES = {"letter": r"\p{L}", "digit": r"\p{N}", "space": r"\s"}
#: Words kept with their tokens in each Python worker.
CACHE_WORDS = 400_000
#: Words encoded at a time.
NEW_WORDS = 20_000
#: Bytes of text taken at a time inside a task.
CHUNK_BYTES = 2_000_000
#: Words of more bytes are walked one by one.
LONG_WORD = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _code_points(low: int, high: int) -> str:
    return "".join(map(chr, range(low, high)))


def library_classes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For every code point the class (place in CLASSES; 3: none of them) that Python's `regex` and the library's pre-split
    give it. Runs of one class in `regex` are asked for as a whole, those that the library cuts sign by sign."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    own, surrogates = np.full(0x110000, 3, np.int8), slice(0xD800, 0xE000)
    text = _code_points(0, 0xD800) + "!" * 0x800 + _code_points(0xE000, 0x110000)
    for i, pattern in enumerate(CLASSES.values()):
        own[[m.start() for m in regex.finditer(pattern, text)]] = i
    found = own.copy()
    edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        i = int(own[low])
        if i == 2 or len(split("a1 !"[i] + text[low:high])) > 1:
            for c in text[low:high]:
                found[ord(c)] = next((k for k, x in ((0, "a"), (1, "1"), (3, "!")) if len(split(x + c)) == 1), 2)
    found[surrogates] = own[surrogates]
    return own, found


def _ranges(points: np.ndarray) -> str:
    """A set of code points as ranges of a pattern's class."""
    edges = np.flatnonzero(np.diff(points.astype(np.int8), prepend=0, append=0))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


@lru_cache(maxsize=4)
def library_pattern(path: str) -> tuple[str, str]:
    """PATTERN with the library's classes, for `regex`, and a class of the code points that need it (empty: none)."""
    own, found = library_classes(path)
    if (own == found).all():
        return PATTERN, ""
    names = []
    for i, name in enumerate(CLASSES.values()):
        more, less = _ranges((found == i) & (own != i)), _ranges((own == i) & (found != i))
        names.append(f"[[{name}{more}]--[{less}]]" if less else f"[{name}{more}]" if more else name)
    letter, digit, space = names
    other = f"[^{space}{letter}{digit}]"
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|{space}+(?![^{space}])|{space}+", f"[{_ranges(own != found)}]"


class Automaton:
    """The compiled automaton as plain arrays, fit to be broadcast: its size is bounded by the vocabulary."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int], pattern: tuple[str, str] = (PATTERN, "")):
        self.special, self.pattern = special, pattern
        self.n = max([*tokens, *special.values()]) + 1
        self.labels = [tokens.get(i, b"") for i in range(self.n)]
        for text, i in special.items():
            self.labels[i] = text.encode()
        self.widths = np.array([len(b) for b in self.labels], np.int64)
        bytes_first = {i: b for i, b in tokens.items() if len(b) == 1}
        self._compile(bytes_first, merges)
        self._trie({tokens[i]: i for i in np.flatnonzero(self.state >= 0).tolist()})

    def _compile(self, singles: dict[int, bytes], merges: list[tuple[int, int, int]]) -> None:
        leads = np.full(self.n, -1, np.int64)  # the state a token leads to; -1: no state has an arc for it
        leads[list(singles)] = 0
        origin, without, since = [0], [-1], [-1]  # of a state: copied from, the arc left out, by which merge
        built: dict[int, list[tuple[int, int]]] = {}  # token -> (merge, token it is the left part of)
        parts: dict[int, tuple[int, int, int]] = {}  # token -> (left part, right part, merge)
        taken: dict[tuple[int, int], int] = {}  # (token, arc that its state lost) -> merge

        def path(u: int, v: int) -> bool:
            """Whether the state that u leads to still has an arc for v: neither u's last parts nor v's first lost it."""
            x, until = u, len(merges)
            while True:
                y, since_y = v, len(merges)
                while True:
                    r = taken.get((x, y))
                    if r is not None and r < until and r <= since_y:
                        return False
                    if y not in parts:
                        break
                    y, _, since_y = parts[y]
                if x not in parts:
                    return True
                _, x, until = parts[x]

        for k, (u, v, w) in enumerate(merges):
            # no path u, v: no arc w. A second merge to a known token has none: its bytes already make that token
            if leads[u] < 0 or leads[v] < 0 or leads[w] >= 0 or not path(u, v):
                continue
            parts[w] = u, v, k
            taken[u, v] = k
            leads[w] = leads[v]
            origin.append(int(leads[u]))
            without.append(v)
            since.append(k)
            leads[u] = len(origin) - 1
            built.setdefault(u, []).append((k, w))
        # preorder, parts of later merges first: what an arc taken away by merge k takes with it is one interval
        self.pos, end = np.zeros(self.n, np.int64), {}
        place, stack = 0, [(i, False) for i in reversed(list(singles))]
        while stack:
            t, done = stack.pop()
            if done:
                end[t] = place
                continue
            self.pos[t] = place
            place += 1
            stack.append((t, True))
            stack.extend((w, False) for _, w in built.get(t, []))  # the last pushed, of the latest merge, comes first
        low, high = [0], [0]
        for v, k in zip(without[1:], since[1:], strict=True):
            low.append(int(self.pos[v]))
            parts = built.get(v, [])
            late = next((w for j, w in parts if j >= k), None)
            high.append(end[late] if late is not None else low[-1] + 1)
        used = np.unique(leads[leads >= 0])
        lists, low, high = [], np.array(low), np.array(high)
        for s in used.tolist():
            own = []
            while s:
                own.append(s)
                s = origin[s]
            own = np.array(own, np.int64)
            own = own[np.argsort(low[own], kind="stable")]
            edges = []
            for a, b in zip(low[own].tolist(), high[own].tolist(), strict=True):
                if edges and a <= edges[-1]:
                    edges[-1] = max(edges[-1], b)
                else:
                    edges += [a, b]
            lists.append(edges)
        self.wide = place + 2
        self.first = np.cumsum([0, *map(len, lists)])[:-1]
        self.edges = np.concatenate([np.array(x, np.int64) + i * self.wide for i, x in enumerate(lists)] or [np.zeros(0, np.int64)])
        self.state = np.where(leads >= 0, np.searchsorted(used, leads), -1)
        self.start = len(lists)  # no list: every arc is there
        self.first = np.append(self.first, len(self.edges))

    def _trie(self, tokens: dict[bytes, int]) -> None:
        arcs: dict[int, int] = {}
        ends = [-1]
        for b, i in tokens.items():
            node = 0
            for x in b:
                key = node << 8 | x
                if key not in arcs:
                    arcs[key] = len(ends)
                    ends.append(-1)
                node = arcs[key]
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        keys = np.array(list(arcs), np.int64)
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        place = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # a slot goes to one of those that want it; the others try the next
            free = todo[self.keys[place[todo]] < 0]
            self.keys[place[free]] = keys[free]
            todo = todo[self.keys[place[todo]] != keys[todo]]
            place[todo] = (place[todo] + 1) % len(self.keys)
        self.to[place] = list(arcs.values())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1 & 0xFFFFFFFFFFFF) >> 16) & ((1 << self.bits) - 1)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The trie nodes that (node, byte) keys lead to; -1: none."""
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.to[slot], -1)
        todo = np.flatnonzero((have != keys) & (have >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) % len(self.keys)
            have = self.keys[slot]
            ok = have == keys[todo]
            out[todo[ok]] = self.to[slot[ok]]
            more = ~ok & (have >= 0)
            todo, slot = todo[more], slot[more]
        return out

    def allowed(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the states have arcs for the tokens: an even number of interval ends lies at or before them."""
        return (np.searchsorted(self.edges, state * self.wide + self.pos[token], "right") - self.first[state]) % 2 == 0

    def starts(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every (position, length, token) at which a token can start; left: bytes to the end of the word."""
        lane, node, depth, found = np.arange(len(data)), np.zeros(len(data), np.int64), 0, []
        while len(lane):
            node = self.step(node << 8 | data[lane + depth])
            ok = node >= 0
            lane, node = lane[ok], node[ok]
            depth += 1
            token = self.ends[node]
            hit = token >= 0
            found.append((lane[hit], np.full(hit.sum(), depth), token[hit]))
            more = left[lane] > depth
            lane, node = lane[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (lane, lane, lane)

    def _walk(self, slots: list[int], lengths: list[int], tokens: list[int], reached: np.ndarray, state: np.ndarray) -> None:
        """The walk of long words, one position after the other, by plain integers."""
        if not hasattr(self, "_plain"):
            self._plain = array("q", self.edges.tolist()), self.first.tolist(), self.pos.tolist(), self.state.tolist()
        edges, first, pos, leads = self._plain
        wide, last = self.wide, len(first) - 1
        low = min(slots)
        arrived, now = reached[low : max(slots) + max(lengths) + 1].tolist(), state[low : max(slots) + max(lengths) + 1].tolist()
        for s, n, t in zip(slots, lengths, tokens, strict=True):
            if arrived[s + n - low] < 0 and (q := now[s - low]) >= 0:
                a = first[q]
                if q == last or (bisect_right(edges, q * wide + pos[t], a, first[q + 1]) - a) % 2 == 0:
                    arrived[s + n - low], now[s + n - low] = t, leads[t]
        reached[low : low + len(arrived)], state[low : low + len(now)] = arrived, now

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word, as 32-bit integers in native order."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if not len(data):
            return [b"" for _ in words]
        offset = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(data)) - offset[word]
        lane, length, token = self.starts(data, size[word] - at)
        # slot i + word holds what arrives before byte i of the word; one slot more for its end
        slots = len(data) + len(words)
        reached, state = np.full(slots, -1, np.int64), np.full(slots, -1, np.int64)
        state[offset + np.arange(len(words))] = self.start
        order = np.argsort(at[lane], kind="stable")
        lane, length, token = lane[order], length[order], token[order]
        slot = lane + word[lane]
        long = size[word[lane]] > LONG_WORD
        short = np.flatnonzero(~long)
        cuts = np.searchsorted(at[lane[short]], np.arange(LONG_WORD + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x = short[a:b]
            x = x[self.allowed(state[slot[x]], token[x])]
            to = slot[x] + length[x]
            reached[to], state[to] = token[x], self.state[token[x]]
        if long.any():
            x = np.flatnonzero(long)
            self._walk(slot[x].tolist(), length[x].tolist(), token[x].tolist(), reached, state)
        # walk back from the words' ends, all words at once
        base = offset + np.arange(len(words))
        here, count = base + size, np.zeros(len(words), np.int64)
        steps = []
        live = np.flatnonzero(size > 0)
        while len(live):
            t = reached[here[live]]
            steps.append((live, t))
            count[live] += 1
            here[live] -= self.widths[t]
            live = live[here[live] > base[live]]
        flat = np.zeros(count.sum(), np.int32)
        last = np.cumsum(count)
        for i, (own, t) in enumerate(steps):
            flat[last[own] - 1 - i] = t
        data, cuts = flat.tobytes(), (4 * np.append(0, last)).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def compile_file(path: str) -> Automaton:
    """The automaton of a byte-level BPE vocabulary in a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    pre, model = file.get("pre_tokenizer") or {}, file["model"]
    odd = [x["content"] for x in file["added_tokens"] if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")]
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or file.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or odd:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary (normaliser, added space, other pre-split, dropout or special strings with options)")
    letters, vocab = byte_letters(), model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if i not in special.values()}
    return Automaton(tokens, merges, special, library_pattern(path))


class Encoder:
    """Encodes texts in a Python worker; keeps words it has seen, within a bound."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.words = automaton, {}
        exact, odd = automaton.pattern
        self.exact, self.plain = regex.compile(exact).findall, regex.compile(PATTERN).findall
        self.odd = re.compile(odd).search if odd else None
        names = sorted(automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def find(self, text: str) -> list[str]:
        """The words of a text without special strings; the plain pattern is faster where it gives the same."""
        return (self.exact if self.odd and not text.isascii() and self.odd(text) else self.plain)(text)

    def split(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            out = []
            for i, part in enumerate(self.special.split(text)):
                out += [f"\0special{part}"] if i % 2 else self.find(part)
            return out
        return self.find(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The tokens of each text, as 32-bit integers in native order."""
        split = [self.split(t) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        known = self.words
        new = list(set(chain.from_iterable(split)).difference(known))
        for i in range(0, len(new), NEW_WORDS):
            part = new[i : i + NEW_WORDS]
            known.update(zip(part, self.automaton.encode([w.encode() for w in part]), strict=True))
        for name, i in self.automaton.special.items():
            known[f"\0special{name}"] = np.int32(i).tobytes()
        return [b"".join(map(known.__getitem__, x)) for x in split]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, automaton: Automaton) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(automaton)
    return _encoders[path]


def _text(labels: list[bytes], ids: np.ndarray) -> str:
    try:
        b = b"".join(map(labels.__getitem__, ids.tolist()))
    except IndexError:
        b = b"".join(labels[i] for i in ids.tolist() if i < len(labels))
    return b.decode("utf-8", "replace")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """df with a column of token ids of `text`: array<int>; decoded: a column for what these ids decode to, in the same pass."""
    path = path or default_path()
    shared = df.sparkSession.sparkContext.broadcast(compile_file(path))
    rest = [c for c in df.columns if c not in (ids, decoded)]
    df = df.select(*[clean_text(c).alias(c) if c == text else F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    at = rest.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _encoder(path, shared.value)
        for batch in it:
            sizes = pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).tolist()
            for part in byte_chunks(sizes, CHUNK_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                found = run(rows.column(at).to_pylist())
                ends = np.cumsum([0, *map(len, found)]) // 4
                flat = np.frombuffer(b"".join(found), np.int32)
                own = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
                if decoded:
                    own.append(pa.array([_text(run.automaton.labels, np.frombuffer(x, np.int32)) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *own], names=schema.names)

    return df.mapInArrow(batches, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text that the token ids stand for; unknown ids stand for nothing, null for empty."""
    path = path or default_path()
    shared = df.sparkSession.sparkContext.broadcast(compile_file(path).labels)
    rest = [c for c in df.columns if c != text]
    df = df.select(*[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    at = rest.index(ids)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        for batch in it:
            out = []
            for i in range(batch.num_rows):
                own = batch.column(at)[i].values
                own = np.zeros(0, np.int32) if own is None else own.drop_null().to_numpy(zero_copy_only=False)
                out.append(_text(labels, own[own >= 0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*rest, text])

    return df.mapInArrow(batches, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    done = encode(docs.select("doc_id", "text"), path=path, decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE: dict[str, str] = {}
