"""Token counts by a compiled finite-state tokenizer (byte-level BPE files of the ``tokenizers`` library).

Two deterministic transducers:

* The splitter reads character classes. Its table has, for each state and class, the next
  state and which word starts the transition emits (before this character, before the one
  before it). A batch is cut into equal chunks that run side by side; each chunk first
  yields its state map (entry state to exit state), the maps are composed by a parallel
  prefix scan, and with its entry state known each chunk emits its word starts.
* The BPE machine reads a word's bytes. A state is a prefix; the transition into it is
  annotated with the tokens that the longer prefix has more (at times fewer) than the
  shorter one. States are determinized when first needed: the last token of a prefix is the
  one token that ends there and may follow the last token of the rest, and a
  pair may stand together if no merge across its border comes first. The machine is
  emptied when it has ``max_states`` states, so memory is bounded.

Texts go through whole; the work is narrow (no shuffle). Defined results: a null text is an
empty one and has no tokens; strings of special tokens inside a text are one token each, as the
library's default has it; repeated rows are counted one by one.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

# The classes of the splitting pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`.
SPACE, WHITE, NUMBER, QUOTE, FINAL, R, V, E, L, LETTER, OTHER, STOP = range(12)
N_CLASSES = 12
STATES = ["start", "letters", "number", "other", "space", "white", "spaces", "whites", "quote", "quote_r", "quote_v", "quote_l"]
HERE, BACK = 1, 2  # a word starts at this character; at the one before it


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and emitted[state, class]."""
    at = {s: k for k, s in enumerate(STATES)}
    nxt, out = np.zeros((len(STATES), N_CLASSES), np.uint8), np.zeros((len(STATES), N_CLASSES), np.uint8)
    kind = {SPACE: "space", WHITE: "white", NUMBER: "number", QUOTE: "quote", OTHER: "other"}
    joins = {"letters": {FINAL, R, V, E, L, LETTER}, "number": {NUMBER}, "other": {QUOTE, OTHER}}
    for state in STATES:
        for c in range(N_CLASSES):
            to, flags = kind.get(c, "letters"), HERE
            if c == STOP:
                to = "start"
            if c in joins.get(state, ()):
                to, flags = state, 0
            elif state in ("space", "white", "spaces", "whites"):
                if c in (SPACE, WHITE):
                    to, flags = ("spaces" if c == SPACE else "whites"), 0
                elif c != STOP:
                    flags = (BACK if state in ("spaces", "whites") else 0) | (HERE if state in ("white", "whites") else 0)
                    if c == QUOTE and state in ("space", "spaces"):
                        to = "other"
            elif state == "quote":
                if c in (QUOTE, OTHER):
                    to, flags = "other", 0
                elif c == FINAL:
                    to, flags = "start", 0
                elif c in (R, V, L):
                    to, flags = {R: "quote_r", V: "quote_v", L: "quote_l"}[c], 0
            elif state in ("quote_r", "quote_v", "quote_l"):
                if c == (L if state == "quote_l" else E):
                    to, flags = "start", 0
                else:
                    flags = BACK | (0 if to == "letters" else HERE)
            nxt[at[state], c], out[at[state], c] = at[to], flags
    return nxt, out


_CLASSES: dict[str, np.ndarray] = {}


def char_classes() -> np.ndarray:
    """The class of each code point, by the library's own notion of letters, numbers and white space."""
    if "table" not in _CLASSES:
        _CLASSES["table"] = _char_classes()
    return _CLASSES["table"]


def _char_classes() -> np.ndarray:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, where = "".join(map(chr, points)), np.array(points)
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        inside = np.ones(len(points), bool)
        for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(text):
            inside[a:b] = False
        table[where[inside]] = c
    for chars, c in ((" ", SPACE), ("'", QUOTE), ("stmd", FINAL), ("r", R), ("v", V), ("e", E), ("l", L)):
        table[[ord(x) for x in chars]] = c
    return table


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """maps[i] takes chunk i's entry state to its exit state; returns the compositions of maps 0..i, by doubling."""
    done, step = maps.copy(), 1
    while step < len(done):
        done[step:] = np.take_along_axis(done[step:], done[:-step].astype(np.intp), 1)
        step *= 2
    return done


def word_starts(classes: np.ndarray, chunk: int = 256, settle: int = 8) -> np.ndarray:
    """Positions at which words start (a STOP is a word by itself)."""
    nxt, out = splitter()
    s, n = len(nxt), len(classes)
    lanes = np.full(-(-n // chunk) * chunk, STOP, np.uint8)
    lanes[:n] = classes
    lanes = np.ascontiguousarray(lanes.reshape(-1, chunk).T)
    m = lanes.shape[1]
    go, emit = nxt.ravel(), out.ravel()
    state = np.repeat(np.arange(s, dtype=np.uint8)[:, None], m, 1)
    for t in range(chunk):
        if t == settle and (state == state[0]).all():
            state = state[:1]
        state = go[state * np.uint8(N_CLASSES) + lanes[t]]
    ends = compose_scan(np.ascontiguousarray(np.broadcast_to(state, (s, m)).T))
    state = np.zeros(m, np.uint8)
    state[1:] = ends[:-1, 0]
    flags = np.empty((chunk, m), np.uint8)
    for t in range(chunk):
        key = state * np.uint8(N_CLASSES) + lanes[t]
        flags[t] = emit[key]
        state = go[key]
    flags = flags.T.ravel()[:n]
    starts = (flags & HERE) > 0
    starts[:-1] |= (flags[1:] & BACK) > 0
    return np.flatnonzero(starts)


class Machine:
    """Counts a word's BPE tokens by annotated transitions, compiled as they are needed."""

    def __init__(self, path: str, max_states: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE files without prefix space or normalizer are compiled")
        special = [x for x in spec.get("added_tokens", [])]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in special):
            raise ValueError(f"{path}: special tokens that take white space or whole words aren't compiled")
        self.special = [x["content"] for x in special]
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.ids = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if all(c in byte for c in token) and token not in self.special}
        name = {k: token for token, k in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.ids[bytes(byte[c] for c in x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[a, b] = rank
            self.halves.setdefault(self.ids[name[a] + name[b]], (a, b, rank))
        self.longest = max(map(len, self.ids))
        self.max_states = max_states
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.emit, self.total, self.last = [0], [0], [-1]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at a token's right (1) or left (0) border while it is made, each with the rank of the merge that ends it."""
        found, until = [(token, float("inf"))], token
        while until in self.halves:
            *half, rank = self.halves[until]
            until = half[side]
            found.append((until, rank))
        return found

    def _crossed(self, a: int, b: int, limit: float) -> bool:
        """Whether a merge of rank under ``limit`` joins the two sides of the border between a and b. Of equal ranks the left one is first."""
        for x, x_ends in self._edge(a, 1):
            for y, y_ends in self._edge(b, 0):
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends and rank < limit:
                    return True
        return False

    def stands(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > self.max_states:
                self.pairs.clear()
            known = self.pairs[a, b] = not self._crossed(a, b, float("inf"))
        return known

    def alone(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        if (known := self.whole.get(token)) is None:
            if token in self.halves:
                a, b, rank = self.halves[token]
                known = self.alone(a) and self.alone(b) and not self._crossed(a, b, rank)
            else:
                known = True
            self.whole[token] = known
        return known

    def _last(self, word: bytes, j: int, last) -> tuple[int, int]:
        """The last token of the first j bytes, and its length; last(i): that of the first i bytes."""
        for size in range(min(j, self.longest), 0, -1):
            token = self.ids.get(word[j - size : j])
            if token is not None and self.alone(token) and (size == j or self.stands(last(j - size), token)):
                return token, size
        raise ValueError("the vocabulary lacks a byte")

    def _long(self, word: bytes) -> int:
        if len(word) > 8 * self.longest and word == word[:1] * len(word):
            return self._same(word)
        last, total = [-1], [0]
        for j in range(1, len(word) + 1):
            token, size = self._last(word, j, last.__getitem__)
            last.append(token)
            total.append(total[j - size] + 1)
        return total[-1]

    def _same(self, word: bytes) -> int:
        """A word of one byte over and over: each step hangs on the last tokens of the ``longest`` steps before alone, so once these come again the rest repeats."""
        last, total, seen = [-1], [0], {}
        for j in range(1, len(word) + 1):
            token, size = self._last(word, j, last.__getitem__)
            last.append(token)
            total.append(total[j - size] + 1)
            window = tuple(last[-self.longest :])
            if j > 2 * self.longest and (before := seen.setdefault(window, j)) < j:
                turns, rest = divmod(len(word) - j, j - before)
                return total[before + rest] + (turns + 1) * (total[j] - total[before])
        return total[-1]

    def count(self, word: bytes) -> int:
        if len(word) > 64:
            return self._long(word)
        if len(self.emit) > self.max_states:
            self.clear()
        state, tokens, path = 0, 0, [0]
        for j, byte in enumerate(word, 1):
            to = self.next.get(state << 8 | byte)
            if to is None:
                token, size = self._last(word, j, lambda i: self.last[path[i]])
                to = self.next[state << 8 | byte] = len(self.emit)
                self.total.append(self.total[path[j - size]] + 1)
                self.emit.append(self.total[-1] - self.total[state])
                self.last.append(token)
            state = to
            path.append(state)
            tokens += self.emit[state]
        return tokens


class Counter:
    """Token counts of many texts at a time."""

    def __init__(self, path: str, batch_chars: int = 1 << 21, max_words: int = 600_000):
        self.machine, self.batch_chars, self.max_words = Machine(path), batch_chars, max_words
        self.special = re.compile("|".join(map(re.escape, sorted(self.machine.special, key=len, reverse=True))) or r"(?!)")
        self.known: dict[bytes, int] = {}

    def _words(self, text: str, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words in ``text`` and each one's count; the characters at ``stops`` only part it. Equal words are found by their bytes."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = char_classes()[points]
        classes[stops] = STOP
        starts = word_starts(classes)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
        spots = np.append(at[starts], at[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(spots), pa.py_buffer(text.encode())]).dictionary_encode()
        known = self.known
        if len(known) > self.max_words:
            known.clear()
        counts = np.empty(len(words.dictionary), np.int64)
        for k, word in enumerate(words.dictionary.to_pylist()):
            c = known.get(word)
            if c is None:
                c = self.machine.count(word)
                if len(word) <= 256:  # so that what is known stays small
                    known[word] = c
            counts[k] = c
        counts = counts[words.indices.to_numpy()]
        counts[np.isin(starts, stops, assume_unique=True)] = 0
        return starts, counts

    def _long(self, text: str) -> int:
        """A text over the batch size: whole words of a window are counted, and the next window starts where they end."""
        total, at, size = 0, 0, self.batch_chars
        while at < len(text):
            part = text[at : at + size]
            starts, counts = self._words(part, np.empty(0, np.int64))
            if at + len(part) >= len(text):
                return total + int(counts.sum())
            sure = int(np.searchsorted(starts, len(part) - 4, "right")) - 1  # later starts may hang on what follows
            if sure < 1:
                return total + sum(self.machine.count(w) for w in self._plain(text[at:]))
            total += int(counts[:sure].sum())
            at += int(starts[sure])
        return total

    def _plain(self, text: str) -> list[bytes]:
        """One word over a whole window: its rest is split by the same machine without the hash's tables."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = word_starts(char_classes()[points])
        return [text[a:b].encode() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], strict=True)]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owner: list[int] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            if pieces:
                sizes = np.array([len(p) + 1 for p in pieces])
                ends = np.cumsum(sizes)
                starts, counts = self._words("\0".join(pieces) + "\0", ends - 1)
                np.add.at(out, np.array(owner)[np.searchsorted(ends, starts, "right")], counts)
                pieces.clear()
                owner.clear()
                chars = 0

        for k, text in enumerate(texts):
            text = text or ""
            split = self.special.split(text) if self.machine.special else [text]
            out[k] += len(split) - 1
            for piece in split:
                if len(piece) + 1 >= self.batch_chars:
                    out[k] += self._long(piece)
                elif piece:
                    if chars + len(piece) + 1 > self.batch_chars:
                        flush()
                    pieces.append(piece)
                    owner.append(k)
                    chars += len(piece) + 1
        flush()
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    """One machine for each Python worker, kept from task to task."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens. ``path``: the tokenizer file, at the same place on every machine."""
    rows = docs.select(docs[f"`{id_col}`"], F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))

    kinds = char_classes()  # made once, for all workers

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        _CLASSES.setdefault("table", kinds)
        texts = batch.column(1).to_pylist()
        sizes = [len(x.encode()) for x in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counter(path)(texts))], [id_col, "n_bytes", "n_tokens"])

    return arrow_map(rows, step, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes bigint, n_tokens bigint")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
