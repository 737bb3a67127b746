"""Byte-level BPE encoding and decoding, vectorised over batches of texts.

Pre-tokenisation needs no regex. Every codepoint is mapped to a symbol by its class (letter, number, space, other) and by what follows it
(a contraction's apostrophe, the last white space before something solid). A symbol is a function from the tokeniser's state before the character to
the state after it. Functions compose associatively, and only few distinct ones arise, so they are numbered and composed by a table: a scan by doubling
joins the function of each position with those before it until it no longer depends on the state it starts from, which takes two or three steps
on any text. A boundary stands where state and symbol say that a new slice begins.

Slices are looked up by their bytes in a cache of merged slices that each Python worker keeps; unknown short ones are merged all at once, one merge of
each slice per step, long ones by a heap of pairs over a linked list. Byte offsets of all tokens are kept, and decoding is a gather of the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text, shared

#: The split pattern that boundaries() reproduces (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beyond ASCII (fixed values of Unicode's White_Space).
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

CHUNK_BYTES = 1 << 20
#: A worker forgets its merged slices when they are more, or have more bytes together.
CACHE_SLICES = 400_000
CACHE_BYTES = 16 << 20
#: Slices of more bytes are merged by a heap.
SHORT_SLICE = 256

# Classes, then symbols. A space is SOLO or JOIN if something solid follows (JOIN: the plain space, which the next slice takes along), else SPACE.
LETTER, NUMBER, OTHER, SPACE, JOIN, SOLO, SHORT, LONG = range(8)
# States: a slice must begin, or the kind of slice that is open; CON1 and CON2 wait for so many more characters of a contraction.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, JOINED, CON1, CON2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after the symbol, and whether a slice begins with it."""
    if state in (CON1, CON2):
        return (BEGIN if state == CON1 else CON1), False
    if symbol in (SHORT, LONG):
        if state in (IN_OTHERS, JOINED):
            return IN_OTHERS, False
        return (CON1 if symbol == SHORT else CON2), True
    if symbol in (JOIN, SOLO):
        return (JOINED if symbol == JOIN else BEGIN), True
    open_as = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: IN_SPACES}[symbol]
    return open_as, not (state == open_as or (state == JOINED and symbol != SPACE))


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """function of each symbol (8 more for a text's first character), composition table, constant value or -1, begins[state, symbol]."""
    functions = [tuple(_step(q, s)[0] for q in range(8)) for s in range(8)]
    functions += [(f[BEGIN],) * 8 for f in functions]
    number = {f: i for i, f in enumerate(dict.fromkeys(functions))}
    symbol = np.array([number[f] for f in functions], np.int16)
    grown = True
    while grown:
        grown = False
        for f in list(number):
            for g in functions:
                if (h := tuple(g[q] for q in f)) not in number:
                    number[h] = len(number)
                    grown = True
    every = list(number)
    table = np.array([[number[tuple(g[q] for q in f)] for g in every] for f in every], np.int16)
    constant = np.array([f[0] if len(set(f)) == 1 else -1 for f in every], np.int8)
    begins = np.array([[_step(q, s)[1] for s in range(8)] for q in range(8)])
    return symbol, table, constant, begins


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every codepoint."""
    out = np.full(0x110000, OTHER, np.int8)
    kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    out[[9, 10, 11, 12, 13, 32, *WIDE_SPACES]] = SPACE
    return out


def boundaries(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where slices begin, of all texts of a chunk."""
    if not len(data):
        return np.zeros(0, np.int64)
    symbol_of, table, constant, begins = _machine()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    ascii_only = n == len(data)
    at = None if ascii_only else np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(n + 1, bool)
    first[offs if ascii_only else np.searchsorted(at, offs)] = True
    kind = _classes()[points]
    space = kind == SPACE
    ended = first[1:]  # the text ends after this character
    last_space = np.zeros(n, bool)
    last_space[:-1] = space[:-1] & ~space[1:] & ~ended[:-1]
    symbols = kind.copy()
    symbols[last_space] = SOLO
    symbols[last_space & (points == 32)] = JOIN
    quotes = np.flatnonzero((points[:-1] == 39) & ~ended[:-1])
    if len(quotes):
        one = points[quotes + 1]
        symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = quotes[(quotes + 2 < n) & ~ended[np.minimum(quotes + 1, n - 1)]]
        both = points[pair + 1].astype(np.uint64) << np.uint64(32) | points[pair + 2]
        symbols[pair[np.isin(both, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))]] = LONG
    # Scan: function of all characters up to here, composed by doubling wherever it isn't constant yet.
    run = symbol_of[symbols.astype(np.int16) + 8 * first[:-1]]
    step, open_at = 1, np.flatnonzero(constant[run] < 0)
    while len(open_at):
        run[open_at] = table[run[open_at - step], run[open_at]]
        open_at = open_at[constant[run[open_at]] < 0]
        step *= 2
    state = np.empty(n, np.int8)
    state[0] = BEGIN
    state[1:] = constant[run[:-1]]
    state[first[:-1]] = BEGIN
    new = np.flatnonzero(begins[state, symbols] | first[:-1])
    return new if ascii_only else at[new]


class Vocabulary:
    """Tokens' bytes and the table of pairs that merge: (left id, right id) -> (rank, new id)."""

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool, added: dict[bytes, int] | None = None):
        self.size = max([*tokens, *(added or {}).values()]) + 1
        tokens = tokens | {i: t for t, i in (added or {}).items()}
        self.whole = {t: i for i, t in tokens.items()} if whole else {}  # a slice that is a token is that token, without merging
        self.added = added or {}  # strings that are one token wherever they stand in a text
        by_bytes = {t: i for i, t in tokens.items()}
        self.byte_ids = np.array([by_bytes[bytes([b])] for b in range(256)], np.int64)
        if self.size > 1 << 20:
            raise ValueError("a vocabulary may have 2^20 tokens")  # pairs are packed into one number
        keys = np.array([a << 20 | b for a, b in pairs], np.uint64)
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, (1 << 64) - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, self.NONE, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int64)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        slot, wait = self._slots(keys), np.arange(len(keys))
        while len(wait):
            free = self.keys[slot[wait]] == np.uint64((1 << 64) - 1)
            take = wait[free][np.unique(slot[wait[free]], return_index=True)[1]]
            self.keys[slot[take]], self.ranks[slot[take]], self.merged[slot[take]] = keys[take], values[take, 0], values[take, 1]
            wait = wait[self.keys[slot[wait]] != keys[wait]]
            slot[wait] = (slot[wait] + 1) & ((1 << self.bits) - 1)
        lengths = np.array([len(tokens.get(i, b"")) for i in range(self.size)])
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(self.size)), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum(lengths)])
        texts = [str(i).encode() + b" " for i in range(self.size)]
        self.digits = np.frombuffer(b"".join(t.ljust(12) for t in texts), np.uint8).reshape(-1, 12)
        self.digits_len = np.array([len(t) for t in texts])

    NONE = (1 << 40) - 1
    _never = (NONE, -1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: they don't merge) and new id of each pair."""
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slot = self._slots(keys)
        open_at = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != np.uint64((1 << 64) - 1)))
        while len(open_at):
            slot[open_at] = (slot[open_at] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[open_at]]
            open_at = open_at[(have != keys[open_at]) & (have != np.uint64((1 << 64) - 1))]
        return self.ranks[slot], self.merged[slot]

    @cache  # noqa: B019 - there are few vocabularies, each kept as long as the worker
    def _by_pair(self) -> dict[int, tuple[int, int]]:
        """(rank, new id) by pair, for pairs that are looked up one by one."""
        at = np.flatnonzero(self.ranks != self.NONE)
        return dict(zip(self.keys[at].tolist(), zip(self.ranks[at].tolist(), self.merged[at].tolist(), strict=True), strict=True))

    def merge_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one slice: its pairs in a heap by rank and place, its symbols in a linked list. As merge(), in n log n steps."""
        symbols = self.byte_ids[data]
        ranks, merged = self.pair(symbols[:-1], symbols[1:])
        at = np.flatnonzero(ranks != self.NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist(), merged[at].tolist(), strict=True))
        heapq.heapify(heap)
        live, ids, n = ranks.tolist(), symbols.tolist(), len(symbols)  # live: the rank of the pair that begins here, -1 if none may merge
        live.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = self._by_pair()

        def look(i: int) -> None:
            live[i], new = known.get(ids[i] << 20 | ids[after[i]], self._never)
            if new >= 0:
                heapq.heappush(heap, (live[i], i, new))

        while heap:
            rank, i, new = heapq.heappop(heap)
            if live[i] != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], live[gone] = new, -1, -1
            follower = after[i] = after[gone]
            if follower < n:
                before[follower] = i
                look(i)
            else:
                live[i] = -1
            if before[i] >= 0:
                look(before[i])
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each slice, end to end, and their counts. All slices advance together, by their lowest pair (the first, if several) per step."""
        lengths = ends - starts
        if len(long := np.flatnonzero(lengths > SHORT_SLICE)):
            short = np.flatnonzero(lengths <= SHORT_SLICE)
            ids, few = self.merge(data, starts[short], ends[short])
            parts = dict(zip(short.tolist(), np.split(ids, np.cumsum(few)[:-1]), strict=True)) if len(short) else {}
            parts |= {i: self.merge_long(data[starts[i] : ends[i]]) for i in long.tolist()}
            every = [parts[i] for i in range(len(starts))]
            return np.concatenate(every), np.array([len(x) for x in every])
        at = np.concatenate([[0], np.cumsum(lengths)])
        symbols = self.byte_ids[data[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])]]
        slices = np.arange(len(starts))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ranks = np.full(len(symbols), self.NONE, np.int64)
        merged = np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            ranks[:-1], merged[:-1] = self.pair(symbols[:-1], symbols[1:])
        ranks[at[1:] - 1] = self.NONE
        while len(slices):
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            best = np.minimum.reduceat(ranks << 10 | (np.arange(len(ranks)) - np.repeat(begin, lengths)), begin)
            go = (best >> 10) != self.NONE
            if not go.all():
                each = np.repeat(go, lengths)
                done.append((slices[~go], lengths[~go], symbols[~each]))
                slices, lengths, best = slices[go], lengths[go], best[go]
                symbols, ranks, merged = symbols[each], ranks[each], merged[each]
                if not len(slices):
                    break
                begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            at = begin + (best & ((1 << 10) - 1))  # slices are shorter than 1024
            symbols[at] = merged[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, ranks, merged = symbols[stay], ranks[stay], merged[stay]
            at = at - np.arange(len(at))
            lengths = lengths - 1
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            last = begin + lengths - 1
            ranks[at] = self.NONE
            some = at[at < last]
            ranks[some], merged[some] = self.pair(symbols[some], symbols[some + 1])
            some = at[at > begin] - 1
            ranks[some], merged[some] = self.pair(symbols[some], symbols[some + 1])
        if not done:
            return np.zeros(0, np.int64), lengths
        order = np.concatenate([d[0] for d in done])
        counts, flat = np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])
        by = np.argsort(order)
        where = np.concatenate([[0], np.cumsum(counts)])[:-1][by]
        counts = counts[by]
        to = np.concatenate([[0], np.cumsum(counts)])
        return flat[np.repeat(where - to[:-1], counts) + np.arange(to[-1])], counts


@lru_cache(4)
def rank_vocabulary(path: str) -> Vocabulary:
    """From a rank file: two tokens merge if their bytes together are a token, by its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                pairs[left, right] = (rank, rank)
    return Vocabulary({i: t for t, i in ranks.items()}, pairs, True)


@lru_cache(4)
def merge_vocabulary(path: str, special: bool = True) -> Vocabulary:
    """From a tokenizer file with a list of merges, as byte-level BPE models have; its added tokens are found in texts, as the library does by default (special)."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ids = model["vocab"]
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs[ids[left], ids[right]] = (rank, ids[left + right])
    added = {t["content"].encode(): t["id"] for t in whole.get("added_tokens") or []}
    tokens = {i: bytes(to_byte[c] for c in t) for t, i in ids.items() if t.encode() not in added}
    return Vocabulary(tokens, pairs, False, added if special else {})


class Encoder:
    """Encodes chunks of texts; keeps merged slices from chunk to chunk."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.n_ids = self.n = self.n_bytes = 0
        added = self.vocabulary.added
        self._learn(list(added), np.array(list(added.values()), np.int64), np.ones(len(added), np.int64))

    def _learn(self, slices: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(counts) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.begin[self.n : self.n + len(counts)] = self.n_ids + np.cumsum(counts) - counts
        self.count[self.n : self.n + len(counts)] = counts
        self.known.update(zip(slices, range(self.n, self.n + len(counts)), strict=True))
        self.n_ids += len(ids)
        self.n += len(counts)
        self.n_bytes += sum(map(len, slices))

    def _merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of slices that aren't known yet."""
        whole = np.array([self.vocabulary.whole.get(x, -1) for x in slices])
        rest = np.flatnonzero(whole < 0)
        ids, few = self.vocabulary.merge(data, starts[rest], ends[rest])
        if len(rest) == len(slices):
            return ids, few
        counts = np.ones(len(slices), np.int64)
        counts[rest] = few
        out = np.repeat(whole, counts)
        out[np.repeat(whole < 0, counts)] = ids
        return out, counts

    def _split(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Byte positions where slices begin; an added token is a slice, and texts begin anew after it."""
        raw = data.tobytes() if self.vocabulary.added else b""
        if not any(t in raw for t in self.vocabulary.added):
            return boundaries(data, offs)
        cuts: list[tuple[int, int]] = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            while True:  # the first added token from here on, the longest if several begin there
                at, size = min(((at, -len(t)) for t in self.vocabulary.added if (at := raw.find(t, a, b)) >= 0), default=(-1, 0))
                if at < 0:
                    break
                a = at - size
                cuts.append((at, a))
        begin, end = np.array(cuts, np.int64).reshape(-1, 2).T
        starts = boundaries(data, np.unique(np.concatenate([offs, begin, end])))
        inside = np.searchsorted(end, starts, "right")
        inside = (inside < len(begin)) & (begin[np.minimum(inside, len(begin) - 1)] < starts)
        return starts[~inside]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and each text's offsets among them."""
        starts = self._split(data, offs)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        first, which = _text.distinct(data, starts, ends)
        if self.n > CACHE_SLICES or self.n_bytes > CACHE_BYTES:
            self._reset()
        raw = data.tobytes()
        slices = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = self.known
        found = np.array([known.get(x, -1) for x in slices], np.int64)
        if len(new := np.flatnonzero(found < 0)):
            own = [slices[i] for i in new.tolist()]
            ids, counts = self._merged(data, starts[first[new]], ends[first[new]], own)
            found[new] = np.arange(self.n, self.n + len(new))
            self._learn(own, ids, counts)
        spots = found[which]
        counts = self.count[spots]
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.begin[spots] - at[:-1], counts) + np.arange(at[-1])]
        return ids, at[np.searchsorted(starts, offs)]


@lru_cache(2)
def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder for each vocabulary file and Python worker; special: whether the strings of added tokens are these tokens."""
    return Encoder(rank_vocabulary(path) if path.endswith(".tiktoken") else merge_vocabulary(path, special))


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes end to end, and where each token begins (one more offset than tokens)."""
    lengths = np.diff(vocabulary.offs)[ids]
    at = np.concatenate([[0], np.cumsum(lengths)])
    return vocabulary.bytes[np.repeat(vocabulary.offs[ids] - at[:-1], lengths) + np.arange(at[-1])], at


def decimals(vocabulary: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, a space after each, as bytes, and where each begins."""
    lengths = vocabulary.digits_len[ids]
    keep = np.arange(12) < vocabulary.digits_len[:, None]
    width = int(lengths.max(initial=0))
    return vocabulary.digits[ids, :width][keep[ids, :width]], np.concatenate([[0], np.cumsum(lengths)])


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and ends (array<int>: the byte in the text at which each token ends), one row per row of docs.

    Null text counts as empty: no ids. Strings of a tokenizer file's added tokens are these tokens, with a rank file all text is ordinary. Repeated rows
    are each encoded; an empty table gives an empty one. Narrow, without shuffle; other columns are ignored. A text is encoded whole, in memory.
    path: the vocabulary file, which must be at the same place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            data, offs = _text.text_bytes(batch.column(1))
            for i, j, d, o in _text.chunks(data, offs, CHUNK_BYTES):
                ids, at = coder.encode(d, o)
                sizes = np.diff(coder.vocabulary.offs)[ids]
                ends = np.cumsum(sizes) - np.repeat(o[:-1], np.diff(at))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], names=["doc_id", "ids", "ends"])

    rows = _rows(docs, doc_id, text)
    return shared.mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (string) of rows with doc_id and ids (null ids: null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                texts.append(None if not ids.is_valid else decode(vocabulary, np.asarray(ids.values.to_numpy(), np.int64))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return shared.mapped(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return shared.picked(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by one space), decoded_sha256 (of the bytes decoded from the ids), one row per row of docs.

    Null text counts as empty, null ids stay null, repeated rows are each encoded, an empty table gives an empty one. Other columns are ignored. Texts of about
    1 MB together, or one longer text, are encoded at a time; a text takes some 40 bytes a byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            data, offs = _text.text_bytes(batch.column(1))
            for i, j, d, o in _text.chunks(data, offs, CHUNK_BYTES):
                ids, at = coder.encode(d, o)
                shown, shown_at = decimals(coder.vocabulary, ids)
                back, back_at = decode(coder.vocabulary, ids)
                shas = []
                for view, cuts, tail in ((memoryview(shown.tobytes()), shown_at[at].tolist(), 1), (memoryview(back.tobytes()), back_at[at].tolist(), 0)):
                    shas.append([hashlib.sha256(view[a : max(a, b - tail)]).hexdigest() for a, b in zip(cuts, cuts[1:])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), *map(pa.array, shas)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    rows = _rows(docs, doc_id, text)
    return shared.mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
