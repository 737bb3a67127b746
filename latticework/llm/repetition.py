"""Quality rules by suffix-array repetition.

Every text is taken as a sequence of words. A suffix array over all words of a chunk of texts is built by prefix doubling:
words get ranks that differ between texts, and the groups of suffixes that still tie after 2^m words are sorted again by the rank of what follows them.
The ranks after each doubling tell in O(log n) steps how many words two suffixes share, so the longest common prefixes of neighbours need no pass over the words.
A suffix whose longest common prefix with a neighbour is at least ``min_words`` begins a repeated substring; the union of these spans is what
all maximal repeated substrings of that length cover (what isn't maximal to the left lies inside the span that begins one word earlier).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text, shared

#: Characters counted as symbols by the base rules (fixed value of the contract).
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, "
    "base_failed boolean, kept boolean"
)

#: Repeated substrings of so many words count; they may cover this share of a text's words, the longest may have so many words.
MIN_WORDS, MAX_COVERED, MAX_LONGEST = 5, 0.3, 60

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def suffix_ranks(ids: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ; the last is the inverse suffix array.

    ids: words as numbers, differing between texts. last: for each position the end of its text.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.ones(n, bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    at = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    rank = np.empty(n, np.int64)
    rank[order] = at[group]
    sizes = np.diff(np.append(at, n))
    active = order[sizes[group] > 1]
    levels, step = [rank.astype(np.int32)], 1
    while len(active):
        then = active + step
        after = np.zeros(len(active), np.int64)
        inside = then < last[active]
        after[inside] = rank[then[inside]] + 1
        key = rank[active] * (n + 2) + after
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        old_first = np.ones(len(active), bool)
        old_first[1:] = old[1:] != old[:-1]
        new_first = np.ones(len(active), bool)
        new_first[1:] = key[1:] != key[:-1]
        here = np.arange(len(active))
        start = np.maximum.accumulate(np.where(old_first, here, 0))
        begun = np.maximum.accumulate(np.where(new_first, here, 0))
        rank = rank.copy()
        rank[active] = old + begun - start
        count = np.diff(np.append(np.flatnonzero(new_first), len(active)))
        active = active[np.repeat(count > 1, count)]
        step *= 2
        levels.append(rank.astype(np.int32))
    return levels


def neighbour_prefix(levels: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """For each position the longest prefix, in words, that its suffix shares with another suffix of its text."""
    n = len(last)
    best = np.zeros(n + 1, np.int64)
    if not n:
        return best[:0]
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    tied = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[tied], order[tied + 1]
    share = np.zeros(len(a), np.int64)
    for m in range(len(levels) - 1, -1, -1):
        x, y = a + share, b + share
        inside = (x < last[a]) & (y < last[b])
        same = np.zeros(len(a), bool)
        same[inside] = levels[m][x[inside]] == levels[m][y[inside]]
        share[same] += 1 << m
    np.maximum.at(best, a, share)
    np.maximum.at(best, b, share)
    return best[:n]


def covered(best: np.ndarray, min_words: int) -> np.ndarray:
    """Flags of the words inside repeated substrings of at least min_words words."""
    n = len(best)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(best >= min_words)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + best[at], -1)
    return np.cumsum(edge)[:n] > 0


def text_repeats(text: str | None, min_words: int = 8) -> list[tuple[int, int]]:
    """The maximal repeated word spans of one text, as (first word, words): what the operator's figures are made of."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    offs = np.array([0, len(data)])
    starts, ends, _ = _text.words(data, offs)
    if not len(starts):
        return []
    ids = _text.distinct(data, starts, ends)[1]
    last = np.full(len(ids), len(ids))
    best = neighbour_prefix(suffix_ranks(ids, last), last)
    left = np.zeros(len(best), bool)
    left[1:] = best[:-1] > best[1:]
    return [(int(i), int(best[i])) for i in np.flatnonzero((best >= min_words) & ~left)]


def _longest(best: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offs) - 1, np.int64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        out[full] = np.maximum.reduceat(best, offs[:-1][full])
    return out


def measure(data: np.ndarray, offs: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """Base figures and repetition figures of each text of a chunk."""
    starts, ends, at = _text.words(data, offs)
    texts = _text.owners(at)
    out = {"n_words": np.diff(at)}
    inside = ~_text._SPACE[data] & ((data & 0xC0) != 0x80)
    out["word_chars"] = _text.per_text(inside, offs)
    out["n_symbols"] = _text.per_text(_SYMBOL[data], offs)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([breaks, offs[1:]]))
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_text = np.searchsorted(offs, line_starts, "right") - 1
    count = len(offs) - 1
    firsts = np.unique(_text.distinct(data, line_starts, line_ends)[1] * count + line_text, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_text, minlength=count) - np.bincount(line_text[firsts], minlength=count)

    key = _text.distinct(data, starts, ends)[1] * count + texts
    last = at[1:][texts]
    best = neighbour_prefix(suffix_ranks(key, last), last)
    out["n_repeat_words"] = _text.per_text(covered(best, 8), at)
    out["covered_words"] = _text.per_text(covered(best, min_words), at)
    out["longest_repeat"] = _longest(best, at)
    return out


def _verdicts(column: pa.Array, min_words: int, max_covered: float, max_longest: int) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for a batch of texts."""
    data, offs = _text.text_bytes(column)
    parts = [measure(d, o, min_words) for _, _, d, o in _text.chunks(data, offs)]
    got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    got["base_failed"] = (got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
    got["kept"] = ~got["base_failed"] & (got["covered_words"] <= max_covered * got["n_words"] + 1e-9) & (got["longest_repeat"] <= max_longest)
    return got


def repetition_rules(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, base_failed, kept.

    A text fails the base rules with fewer than 20 words, or if more than 30 % of its words lie in 8-word windows found twice in it.
    It fails the method if repeated substrings of at least ``min_words`` words cover more than ``max_covered`` of its words, or the longest
    repeated substring has more than ``max_longest`` words.
    Narrow: one pass, no shuffle. Null or empty text: no words, all figures 0, not kept. Repeated rows are each judged. An empty table gives an empty one.
    Columns of docs that have the name of a figure are replaced by it; other columns pass through.
    Words and lines are compared by their bytes. Memory is that of one chunk of texts (about 1 MB, or one longer text) times some 200 bytes a word.
    """

    def judge(column: pa.Array) -> list[pa.Array]:
        got = _verdicts(column, min_words, max_covered, max_longest)
        return [pa.array(got[x.split()[0]]) for x in SCHEMA.split(", ")]

    return shared.annotated(docs, text, SCHEMA, judge)


def op4_repetition_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id and the figures and verdicts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition_rules(docs).drop("text")


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass the quality rules, with all columns of docs as they are. Null and empty texts go; repeated rows are each judged."""
    return shared.filtered(docs, "text", lambda column: pa.array(_verdicts(column, MIN_WORDS, MAX_COVERED, MAX_LONGEST)["kept"]))
