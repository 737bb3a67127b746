"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

Merging takes the best pair of neighbours again and again. What it ends in is the only sequence of pieces in which every two neighbours are compatible: merged
again from their characters, the two of them give these two pieces. So no merging of whole texts is needed:

* a text is cut wherever no piece holds the two characters at hand, since no merge can cross there; distinct slices are encoded once and kept, as in ``bpe``;
* an Aho-Corasick automaton finds the longest piece that begins at each place of a slice;
* from left to right the longest piece is taken that is compatible with the one before; if there is none, a shorter one, and if none is left the place is marked
  in a field of failed positions, the last piece is taken back and a shorter one tried. A place is reached by one sequence only, so it fails for good, and the
  work is linear in the slice.

Characters that are no piece become bytes. Normalisation is that of models that only put a space in front and write spaces as U+2581; other models are refused.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text, bpe, shared

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: A worker forgets which pairs are compatible when it knows so many.
CACHE_PAIRS = 1_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            if key & 7 == 2:
                size, i = varint(i)
            else:
                size = {1: 8, 5: 4}[key & 7]
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


class PieceModel:
    """What a model file says: pieces, their scores and kinds. ``bytes``, ``offs``, ``digits`` and ``digits_len`` are as in ``bpe.Vocabulary``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer, normalizer = (dict(_fields(dict(parts).get(k, b""))) for k in (2, 3))
        # fields of the format (fixed values): 2.3 model type (2: BPE), 2.24 space at the end, 2.35 byte fallback, 2.48 text of the unknown piece; 3.2 rules, 3.3 space in front, 3.4 spaces removed, 3.5 spaces escaped
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or not normalizer.get(3, 1):
            raise ValueError(f"{path} isn't a BPE model with bytes for unknown characters, a space in front and no other normalisation")
        self.pieces, self.scores, self.kinds = [], [], []
        for number, value in parts:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
        if extra := set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"pieces of kind {extra} aren't known")
        self.size = len(self.pieces)
        self.end = trainer.get(42, 2)
        unknown = trainer.get(44, " ⁇ ".encode())
        self.of_byte = np.zeros(256, np.int64)
        own = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == BYTE:
                self.of_byte[int(piece[3:5], 16)] = i
            own.append({NORMAL: piece.replace(SPACE, " ").encode(), UNKNOWN: unknown, CONTROL: b""}.get(kind) if kind != BYTE else bytes([int(piece[3:5], 16)]))
        self.bytes = np.frombuffer(b"".join(own), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        self.is_byte = np.array(self.kinds) == BYTE
        texts = [str(i).encode() + b" " for i in range(self.size)]
        self.digits = np.frombuffer(b"".join(t.ljust(12) for t in texts), np.uint8).reshape(-1, 12)
        self.digits_len = np.array([len(t) for t in texts])
        self.added: dict[bytes, int] = {}
        self._prepare()

    def _prepare(self) -> None:
        import ahocorasick

        normal = {p: i for i, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == NORMAL}
        self.rank = {p: -self.scores[i] for p, i in normal.items()}
        # characters that only occur within pieces get numbers beyond the model's, and are written as bytes
        loose = sorted({c for p in normal for c in p} - normal.keys())
        self.number = normal | {c: self.size + k for k, c in enumerate(loose)}
        self.number = {p: i for p, i in self.number.items() if len(p) == 1 or self.merged(p) == [p]}  # others can't be merged
        self.text = {i: p for p, i in self.number.items()}
        self.length = {i: len(p) for i, p in self.text.items()}
        self.shorter = {i: next((self.number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.number), -1) for i, p in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        letters = sorted({c for p in normal for c in p})
        self.letter = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letter[32] = self.letter[ord(SPACE)]
        self.n_letters = len(letters) + 1
        self.joined = np.zeros(self.n_letters**2, bool)  # whether some piece holds the two characters next to each other
        pairs = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        for a, b in pairs:
            self.joined[int(self.letter[ord(a)]) * self.n_letters + int(self.letter[ord(b)])] = True
        self.agreed: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging as the model defines it: the best pair of neighbours, the first of equals, until none is a piece. For short texts."""
        parts, never = list(text), float("inf")
        ranks = [self.rank.get(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            for j in (i - 1, i):
                if 0 <= j < len(ranks):
                    ranks[j] = self.rank.get(parts[j] + parts[j + 1], never)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are when their characters are merged again."""
        found = self.agreed.get((left, right))
        if found is None:
            if len(self.agreed) >= CACHE_PAIRS:
                self.agreed.clear()
            a, b = self.text[left], self.text[right]
            found = self.agreed[left, right] = self.merged(a + b) == [a, b]
        return found

    def encode_slice(self, text: str) -> list[int]:
        """Ids of a slice by backtracking."""
        n, length, shorter, compatible = len(text), self.length, self.shorter, self.compatible
        if n == 1 and text not in self.number:
            return self._written([text])
        longest = [-1] * n
        for last, piece in self.automaton.iter(text):  # ends grow, so the longest piece of a place comes last
            longest[last + 1 - length[piece]] = piece
        failed = bytearray(n + 1)
        found: list[int] = []
        at, piece = 0, longest[0]
        while True:
            while piece >= 0 and (failed[at + length[piece]] or (found and not compatible(found[-1], piece))):
                piece = shorter[piece]
            if piece >= 0:
                found.append(piece)
                at += length[piece]
                if at == n:
                    break
                piece = longest[at]
            else:
                failed[at] = 1
                piece = found.pop()
                at -= length[piece]
        return found if max(found) < self.size else self._written(found)

    def _written(self, found: list) -> list[int]:
        """Characters that are no piece as their bytes' ids."""
        out: list[int] = []
        for x in found:
            if isinstance(x, int) and x < self.size:
                out.append(x)
            else:
                out += self.of_byte[list((x if isinstance(x, str) else self.text[x]).encode())].tolist()
        return out


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front (empty ones stay empty) and a space for each U+2581, which can't be told from one."""
    n = len(data)
    mark = np.zeros(n, bool)
    if n > 2:
        mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    if mark.any():
        at = np.flatnonzero(mark)
        data = data.copy()
        data[at] = 32
        keep = np.ones(n, bool)
        keep[at + 1] = keep[at + 2] = False
        data, offs = data[keep], np.concatenate([[0], np.cumsum(keep)])[offs]
    full = np.diff(offs) > 0
    return np.insert(data, offs[:-1][full], 32), offs + np.concatenate([[0], np.cumsum(full)])


class PieceEncoder(bpe.Encoder):
    """Encodes chunks of normalised texts; keeps the ids of slices from chunk to chunk."""

    def _split(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(0, np.int64)
        model = self.vocabulary
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.arange(len(data)) if len(points) == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
        letters = model.letter[points].astype(np.int64)
        new = np.ones(len(points), bool)
        new[1:] = ~model.joined[letters[:-1] * model.n_letters + letters[1:]]
        first = np.searchsorted(at, offs[:-1])
        new[first[first < len(new)]] = True
        return at[new]

    def _merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.vocabulary.encode_slice(x.decode().replace(" ", SPACE)) for x in slices]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each model file and Python worker."""
    return PieceEncoder(PieceModel(path))


def decode(model: PieceModel, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of lists of ids (at: their offsets) as UTF-8 bytes end to end, and their offsets.

    Control pieces give nothing, the unknown piece its text; of the first other piece a leading space goes. Bytes that aren't UTF-8 become U+FFFD each;
    bytes of one character may have control pieces between them (the library would replace them), which no encoding gives.
    """
    lengths = np.diff(model.offs)[ids]
    data, cuts = bpe.decode(model, ids)
    offs = cuts[at]
    spoken = np.flatnonzero(lengths > 0)
    first = np.searchsorted(spoken, at[:-1])
    first = spoken[first[first < len(spoken)]] if len(spoken) else spoken
    first = np.unique(first)
    first = first[np.array(model.kinds)[ids[first]] == NORMAL] if len(first) else first
    gone = cuts[first][data[cuts[first]] == 32] if len(first) else first
    keep = np.ones(len(data), bool)
    keep[gone] = False
    data, offs = data[keep], np.concatenate([[0], np.cumsum(keep)])[offs]
    try:
        data.tobytes().decode()
        return data, offs
    except UnicodeDecodeError:
        texts = [_replaced(data[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _replaced(raw: bytes) -> bytes:
    """raw with U+FFFD for every byte that is no part of a character."""
    out = b""
    while True:
        try:
            raw.decode()
            return out + raw
        except UnicodeDecodeError as e:
            out += raw[: e.start] + b"\xef\xbf\xbd"
            raw = raw[e.start + 1 :]


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, ids, offsets) of chunks of texts, an end id after each text."""
    coder = encoder(path)
    for batch in batches:
        data, offs = _text.text_bytes(batch.column(1))
        for i, j, d, o in _text.chunks(data, offs, bpe.CHUNK_BYTES):
            ids, at = coder.encode(*normalised(d, o))
            yield batch.column(0).slice(i, j - i), np.insert(ids, at[1:], coder.vocabulary.end), at + np.arange(len(at))


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>, an end id last), one row per row of docs.

    Null text counts as empty: the end id only. Pieces' names within texts are plain text. Repeated rows are each encoded; an empty table gives an empty one. Narrow,
    without shuffle; other columns are ignored. A text is encoded whole, in memory. path: the model file, at the same place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, at in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    rows = bpe._rows(docs, doc_id, text)
    return shared.mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null ids: null text; null elements aren't allowed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path).vocabulary
        for batch in batches:
            lists = batch.column(1)
            at = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])]).astype(np.int64)
            ids = [np.asarray(x.values.to_numpy(), np.int64) for x in lists if x.is_valid]
            data, offs = decode(model, np.concatenate(ids) if ids else np.zeros(0, np.int64), at)
            raw = data.tobytes()
            texts = [raw[a:b].decode() if x.is_valid else None for x, a, b in zip(lists, offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return shared.mapped(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by one space, the end id last), decoded_sha256 (of the text decoded from the ids), one row per row of docs.

    Null text counts as empty, null ids stay null, repeated rows are each encoded, an empty table gives an empty one. Other columns are ignored. Texts of about
    1 MB together, or one longer text, are encoded at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path).vocabulary
        for keys, ids, at in _coded(batches, path):
            shown, shown_at = bpe.decimals(model, ids)
            back, back_at = decode(model, ids, at)
            shas = []
            for view, cuts, tail in ((memoryview(shown.tobytes()), shown_at[at].tolist(), 1), (memoryview(back.tobytes()), back_at.tolist(), 0)):
                shas.append([hashlib.sha256(view[a : max(a, b - tail)]).hexdigest() for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at)), *map(pa.array, shas)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = bpe._rows(docs, doc_id, text)
    return shared.mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
