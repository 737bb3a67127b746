"""Language identification by mixtures: each document's language proportions by expectation-maximisation over n-gram likelihoods.

A model holds for every language the smoothed likelihoods of hashed letter trigrams (lower-cased, anything but letters is a word's edge), counted over all
learning documents. A document's trigrams are taken as drawn from a mixture of languages. Expectation-maximisation over all languages estimates the
proportions; then sets of one, two and more languages are fitted again, and the set with the best penalised likelihood (log likelihood less
``penalty`` * ln(trigrams + 1) for each language) is kept: each language alone, the languages with the largest proportions, and the set of the step before with
the language that raises its likelihood most. Sets grow as long as a larger one can still win: the log likelihood is concave in the
proportions, so no set exceeds that of all languages by more than its gradient shows, and beyond that the penalty alone decides.

The prediction is the set's largest language. The score is its proportion times a confidence that weighs the set's penalised likelihood against that of
the next best language alone. Trigrams of a text aren't independent, so they count as ``EVIDENCE`` trigrams at most there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _text, shared

BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Expectation-maximisation ends for a text when its log likelihood can't grow by more than GAP; after PLAIN rounds every third one is extrapolated.
PLAIN, GAP = 24, 0.05
PENALTY = 4.0
EVIDENCE = 8
#: A model of more languages is an error unless learn() is told so: it is 128 KB a language on every task. Learning flushes its sums when a task holds as many.
MOST_LANGUAGES = 256


class Model(NamedTuple):
    languages: list[str]
    likelihoods: np.ndarray  # bucket x language


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case form of every letter's codepoint, 0 for anything else."""
    out = np.zeros(0x110000, np.uint32)
    kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    for i in np.flatnonzero(kinds == ord("L")).tolist():
        low = chr(i).lower()
        out[i] = ord(low) if len(low) == 1 else i
    return out


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams that hold two letters at least, the text of each, and whether each text has a letter."""
    count = len(offs) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    cuts = np.searchsorted(starts, offs) + np.arange(count + 1)  # an edge is put before each text and after the last
    letters = np.insert(_letters()[points], np.searchsorted(starts, offs), 0)
    text = np.repeat(np.arange(count), np.diff(cuts))
    solid = letters != 0
    has = _text.per_text(np.append(solid, False)[: cuts[-1]], cuts) > 0
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    a, b, c = letters[:-2].astype(np.uint64), letters[1:-1].astype(np.uint64), letters[2:].astype(np.uint64)
    use = solid[1:-1] & (solid[:-2] | solid[2:])
    key = (a[use] << np.uint64(42)) | (b[use] << np.uint64(21)) | c[use]
    return (_text.mix(key) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), text[np.flatnonzero(use) + 1], has


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = SMOOTHING, most: int = MOST_LANGUAGES) -> Model:
    """A model from all rows with text and language (null in either: not learned from; an empty table: a model of no language).

    Counts are summed per task, then over tasks; at most ``most`` languages x 16384 sums reach the driver and, as likelihoods, all tasks. More values of lang are
    an error: no language is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, row in sums.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            data, offs = _text.text_bytes(batch.column(0))
            names = batch.column(1).to_pylist()
            for i, j, d, o in _text.chunks(data, offs):
                own, which = np.unique(np.array(names[i:j], dtype=object).astype(str), return_inverse=True)
                bucket, doc, _ = trigrams(d, o)
                key, n = np.unique(which[doc] * BUCKETS + bucket, return_counts=True)
                for k in np.unique(key // BUCKETS).tolist():
                    mine = key // BUCKETS == k
                    row = sums.setdefault(own[k], np.zeros(BUCKETS, np.int64))
                    row[key[mine] % BUCKETS] += n[mine]
                    if len(sums) >= MOST_LANGUAGES:
                        yield from flush()
        yield from flush()

    rows = shared.picked(docs, text=text, lang=lang).select(F.col("text").cast("string"), F.col("lang").cast("string")).dropna()
    counted = shared.mapped(rows, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = shared.written(counted, "lang-counts")
    if counted.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"lang has more than {most} values; most sets how many a model may have")
    found = counted.toArrow()
    shared.drop(counted)
    languages, own = np.unique(np.array(found.column("lang").to_pylist(), dtype=str), return_inverse=True)
    grid = np.zeros((BUCKETS, len(languages)))
    grid[found.column("bucket").to_numpy(), own] = found.column("n").to_numpy()
    return Model(languages.tolist(), (grid + smoothing) / (grid.sum(axis=0) + smoothing * BUCKETS))


def _fit(like: np.ndarray, count: np.ndarray, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation from ``weights`` on, log likelihoods, and by how much these could grow at most over the same languages: GAP or less.

    Rows of like belong to texts, in order; at: each text's first row. A text that has converged is left alone. Where likelihoods are flat, steps shorten; so after
    PLAIN rounds three proportions in a row are extrapolated, and what comes of it is taken where it is likelier. Every round raises the likelihood, so all texts converge.
    """
    weights, value, gap = weights.copy(), np.zeros(len(at)), np.zeros(len(at))
    total, active = np.add.reduceat(count, at), np.arange(len(at))
    sizes = np.diff(np.append(at, len(count)))
    past: list[np.ndarray] = []  # the last two proportions of the active texts
    turn = 0
    while True:
        doc = np.repeat(np.arange(len(active)), sizes[active])
        begin = np.cumsum(sizes[active]) - sizes[active]
        if turn >= PLAIN and turn % 3 == 2:
            now, (before, between) = weights[active], past
            step, bend = between - before, now - 2 * between + before
            length = np.sqrt((step**2).sum(axis=1) / np.maximum((bend**2).sum(axis=1), 1e-300))[:, None]
            far = np.where(now > 0, np.maximum(before + 2 * length * step + length**2 * bend, 1e-3 * now), 0)
            far /= far.sum(axis=1, keepdims=True)
            both = [np.add.reduceat(count * np.log(np.einsum("ij,ij->i", like, w[doc])), begin) for w in (now, far)]
            better = both[1] > both[0]
            weights[active[better]] = far[better]
        mixed = np.einsum("ij,ij->i", like, weights[active][doc])
        pull = np.add.reduceat(like * (count / mixed)[:, None], begin, axis=0) / total[active, None]
        value[active] = np.add.reduceat(count * np.log(mixed), begin)
        gap[active] = total[active] * np.maximum(0, np.where(weights[active] > 0, pull, 0).max(axis=1) - 1)
        more = gap[active] > GAP
        if not more.any():
            return weights, value, gap
        past = [*(w[more] for w in past[-1:]), weights[active[more]].copy()]
        weights[active[more]] *= pull[more]
        if not more.all():
            like, count, active = like[more[doc]], count[more[doc]], active[more]
        turn += 1


class Mixtures(NamedTuple):
    shares: np.ndarray  # text x language, 0 for languages that aren't selected
    confidence: np.ndarray
    has: np.ndarray  # whether a text has a letter


def mixtures(data: np.ndarray, offs: np.ndarray, model: Model, penalty: float = PENALTY) -> Mixtures:
    """The language mixtures of a chunk's texts."""
    count_texts, n_lang = len(offs) - 1, len(model.languages)
    out, sure = np.zeros((count_texts, n_lang)), np.full(count_texts, 1 / max(1, n_lang))
    bucket, doc, has = trigrams(data, offs)
    # a single letter between edges makes no trigram of two letters; such a text gets equal proportions
    out[has] = 1 / max(1, n_lang)
    if not len(bucket) or not n_lang:
        return Mixtures(out, np.ones(count_texts), has)
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc, like, count = key // BUCKETS, model.likelihoods[key % BUCKETS], count.astype(float)
    texts, at = np.unique(doc, return_index=True)
    doc, every = np.searchsorted(texts, doc), np.arange(len(texts))
    total = np.add.reduceat(count, at)
    price = penalty * np.log(total + 1)
    alone = np.add.reduceat(count[:, None] * np.log(like), at, axis=0) - price[:, None]  # each language by itself
    full, most, gap = _fit(like, count, at, np.full((len(texts), n_lang), 1 / n_lang))
    most = most + gap
    best = np.zeros_like(full)
    first = np.argmax(alone, axis=1)
    best[every, first], score = 1.0, alone[every, first]
    grown, rank = best > 0, np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    for k in range(2, n_lang + 1):
        going = most - k * price > score
        if not going.any():
            break
        pick, rows = np.flatnonzero(going), going[doc]
        part, own = like[rows], np.searchsorted(pick, doc[rows])
        begin = np.unique(own, return_index=True)[1]

        def tried(some: np.ndarray, sets: np.ndarray) -> np.ndarray:
            """The penalised likelihoods of sets of k languages for some of the picked texts; the best so far is kept."""
            use = np.zeros(len(pick), bool)
            use[some] = True
            use = use[own]
            start = np.where(sets, np.maximum(full[pick[some]], 0.01), 0)
            mine = np.unique(np.searchsorted(some, own[use]), return_index=True)[1]
            got, value, _ = _fit(part[use], count[rows][use], mine, start / start.sum(axis=1, keepdims=True))
            value = value - k * price[pick[some]]
            better = value > score[pick[some]]
            best[pick[some[better]]], score[pick[some[better]]] = got[better], value[better]
            return value

        tried(np.arange(len(pick)), rank[pick] < k)  # the k largest proportions
        # and the last set with one more language, of those that can raise its likelihood the one that does most
        held = grown[pick] / grown[pick].sum(axis=1, keepdims=True)
        fitted, _, _ = _fit(part, count[rows], begin, held)
        pull = np.add.reduceat(part * (count[rows] / np.einsum("ij,ij->i", part, fitted[own]))[:, None], begin, axis=0) / total[pick, None]
        top, which = np.full(len(pick), -np.inf), np.zeros(len(pick), np.int64)
        for j in range(n_lang):
            some = np.flatnonzero(~grown[pick, j] & (pull[:, j] > 1))
            if len(some):
                sets = grown[pick[some]].copy()
                sets[:, j] = True
                value = tried(some, sets)
                more = value > top[some]
                top[some[more]], which[some[more]] = value[more], j
        found = np.isfinite(top)
        grown[pick[found], which[found]] = True
        most[pick[~found]] = -np.inf  # no language can raise its likelihood, which so is that of all languages
    out[texts] = best
    if n_lang > 1:
        alone[every, np.argmax(best, axis=1)] = -np.inf
        margin = (score - alone.max(axis=1)) / total * np.minimum(total, EVIDENCE)
        sure[texts] = 1 / (1 + np.exp(-np.clip(margin, 0, 700)))
    return Mixtures(out, sure, has)


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score, langs (selected languages, largest first) and shares (their proportions).

    Null texts and texts without a letter: und, score 0, no languages; so too all texts if the model knows no language. Ties go to the language that sorts
    first. Whole texts are used; only the text is. Repeated rows are each judged; an empty table gives an empty one. One pass, no shuffle; the model (16384 numbers
    a language) is broadcast. Columns of docs that have the name of a new one are replaced by it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return shared.annotated(docs, text, "lang_pred string, score double, langs array<string>, shares array<double>", lambda column: judged(column, held.value, penalty))


def judged(column: pa.Array, model: Model, penalty: float) -> list[pa.Array]:
    """lang_pred, score, langs and shares of a batch of texts."""
    preds, scores, langs, shares = [], [], [], []
    data, offs = _text.text_bytes(column)
    for _, _, d, o in _text.chunks(data, offs, max(1 << 16, 4 * _text.CHUNK_BYTES // max(4, len(model.languages)))):
        weights, sure, has = mixtures(d, o, model, penalty)
        order = np.argsort(-weights, axis=1, kind="stable")
        for row, by, known, trust in zip(weights.tolist(), order.tolist(), has.tolist(), sure.tolist(), strict=True):
            top = [x for x in by if row[x] > 0] if known else []
            preds.append(model.languages[top[0]] if top else "und")
            scores.append(min(1.0, row[top[0]]) * trust if top else 0.0)
            langs.append([model.languages[x] for x in top])
            shares.append([row[x] for x in top])
    return [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]


def learning(docs: DataFrame) -> DataFrame:
    """text and lang of the documents that aren't held out, whatever else docs holds."""
    return shared.picked(docs, doc_id="doc_id", text="text", lang="lang").filter(~held_out())


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 on division by 3. Null ids aren't held out, and aren't learned from."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % 3 == 1


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """held_out, lang_pred, score and the selected languages of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(learning(docs)))
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        F.array_join("langs", ",").alias("langs"),
    )


def one_language(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents of which one language has at least half, with all columns of docs as they are; und goes.

    Learns as op10_language_id does, from docs. If nothing can be learned from, all documents are und and go. Null doc_ids are neither held out nor learned from.
    """
    held = spark.sparkContext.broadcast(learn(learning(docs)))

    def keep(column: pa.Array) -> pa.Array:
        _, _, _, shares = judged(column, held.value, PENALTY)
        return pa.array([bool(x) and x[0] >= least for x in shares.to_pylist()], pa.bool_())

    return shared.filtered(docs, "text", keep)
