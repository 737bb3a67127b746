"""Alignment of two tokenizers' tokens over a corpus: which tokens cover the same bytes, how often in all, and how well each document agrees with that.

Both tokenizers encode the same bytes, so their tokens are two divisions of one line. Cut where either ends a token, the line falls into pieces that each lie in one
token of either side: a piece is a link. Where both end, a group ends.

* One pass over the documents encodes both sides and writes, beside each document's own figures, postings: for each id of side B a list of (document, id of side A,
  multiplicity within the document), made for about 1 MB of texts at a time.
* Postings are summed to counts of id pairs before anything is shuffled; only sums are.
* Counts and postings meet by id of side B. A stream is sorted by Spark, which spills: an id's counts come first (at most as many as side A has ids), its postings follow
  block by block, so a task holds one id's counts and one block. Ids with very many postings are dealt out to several tasks by a number in their key, and their
  counts are sent to each of these.
* Each block gives what it adds to its documents, as one row with arrays, to the task of the texts that the block came from, which sums by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _text, bpe, pieces, shared

#: A list of postings has so many at most.
BLOCK = 1 << 15
#: Postings of one id that a task is to take, more or less.
SHARE = 1 << 20
_OWN = ["n_a", "n_b", "n_groups", "n_links"]


def linked(data: np.ndarray, offs: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as (number of the A token, number of the B token, text), and the group of every A and B token. ends: where tokens end within data."""
    marks = [np.zeros(len(data) + 1, bool) for _ in ends]
    for mark, at in zip(marks, ends, strict=True):
        mark[at] = True
    stops = np.flatnonzero(marks[0] | marks[1])
    number = [np.cumsum(mark)[stops] - mark[stops] for mark in marks]
    both = marks[0] & marks[1]
    closed = np.cumsum(both)
    groups = [closed[at] - both[at] for at in ends]
    text = np.searchsorted(offs, stops, "left") - 1
    return number[0], number[1], text, groups[0], groups[1]


def group_texts(sides: list[tuple[np.ndarray, np.ndarray, object]], offs_a: np.ndarray, offs_b: np.ndarray) -> list[str]:
    """SHA-256 of every text's groups as ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens. sides: (ids, group of each token, vocabulary)."""
    (a, group_a, words_a), (b, group_b, words_b) = sides
    group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(group * 2 + side, kind="stable")
    kind = side[order]
    shown = [bpe.decimals(v, x) for v, x in ((words_a, a), (words_b, b))]
    data = np.concatenate([shown[0][0], shown[1][0]])
    begin = np.concatenate([shown[0][1][:-1], shown[1][1][:-1] + len(shown[0][0])])[order]
    size = np.concatenate([np.diff(shown[0][1]), np.diff(shown[1][1])])[order]
    at = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
    tail = np.full(len(order), ord(","), np.uint8)
    if len(order):
        turn = np.append(kind[1:] != kind[:-1], True)
        tail[turn] = np.where(kind[turn] == 0, ord("|"), ord(";"))
        flat[at[1:] - 1] = tail
    cuts = at[offs_a + offs_b]
    view = memoryview(flat.tobytes())
    return [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(cuts.tolist(), cuts[1:].tolist())]


def _spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front; texts that the second tokenizer's normalisation changes beyond that become empty, as empty ones stay."""
    changed, cuts = pieces.normalised(data, offs)
    size = np.diff(offs)
    same = (np.diff(cuts) == size + 1) & (size > 0)
    keep = np.repeat(same, np.diff(cuts))
    return changed[keep], np.concatenate([[0], np.cumsum(np.where(same, np.diff(cuts), 0))])


def postings(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """From (row, doc_id, text): a row (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) for each document, and rows (b, chunk, docs, a, times) of postings, the other columns null.

    row must count on by one within a task. chunk is the row of the first of the texts that were encoded together, docs counts on from there."""
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b int, chunk long, docs array<int>, a array<int>, times array<int>"
    fields = pa.schema(
        [("row", pa.int64()), ("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), *((c, pa.int64()) for c in _OWN), ("groups_sha256", pa.string()), ("b", pa.int32()), ("chunk", pa.int64())]
        + [("docs", pa.list_(pa.int32())), ("a", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    )

    def lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values).cast(kind))

    def none(n: int, names: list[str]) -> dict[str, pa.Array]:
        return {c: pa.nulls(n, fields.field(c).type) for c in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = bpe.encoder(path_a, False), pieces.encoder(path_b)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, j, d, o in _text.chunks(*_text.text_bytes(batch.column(2)), bpe.CHUNK_BYTES):
                d, o = _spaced(d, o)
                (a, at_a), (b, at_b) = (c.encode(d, o) for c in coders)
                ends = tuple(np.cumsum(np.diff(c.vocabulary.offs)[x]) for c, x in zip(coders, (a, b), strict=True))
                link_a, link_b, text, group_a, group_b = linked(d, o, ends)
                n, groups = j - i, group_a[-1] + 1 if len(group_a) else 0
                owner = np.zeros(groups, np.int64)
                owner[group_a] = _text.owners(at_a)
                own = {"n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": np.bincount(owner, minlength=n), "n_links": np.bincount(text, minlength=n)}
                shas = group_texts([(a, group_a, coders[0].vocabulary), (b, group_b, coders[1].vocabulary)], at_a, at_b)
                out = {"row": pa.array(keys[i:j]), "doc_id": batch.column(1).slice(i, j - i), **{c: pa.array(v.astype(np.int64)) for c, v in own.items()}, "groups_sha256": pa.array(shas, pa.string())}
                yield pa.RecordBatch.from_arrays([(out | none(n, ["b", "chunk", "docs", "a", "times"]))[f.name] for f in fields], schema=fields)
                wide = coders[0].vocabulary.size
                key, times = np.unique((b[link_b].astype(np.int64) * wide + a[link_a]) * n + text, return_counts=True)
                if not len(key):
                    continue
                pair, text = key // n, key % n
                side = pair // wide
                first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
                cuts = np.unique(np.concatenate([first, np.arange(0, len(key), BLOCK), [len(key)]]))
                out = {"b": pa.array(side[cuts[:-1]].astype(np.int32)), "chunk": pa.array(np.full(len(cuts) - 1, keys[i]))}
                out |= {"docs": lists(text, cuts, pa.int32()), "a": lists(pair % wide, cuts, pa.int32()), "times": lists(times, cuts, pa.int32())}
                yield pa.RecordBatch.from_arrays([(out | none(len(cuts) - 1, ["row", "doc_id", *_OWN, "groups_sha256"]))[f.name] for f in fields], schema=fields)

    return shared.mapped(docs, run, schema)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy()


def _sizes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return np.diff(np.asarray(column.offsets))


def pair_counts(lists: DataFrame) -> DataFrame:
    """(b, a, count, lists): links of each pair of ids in the corpus, and how many postings there are. Summed in each batch, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.repeat(batch.column("b").to_numpy().astype(np.int64), _sizes(batch, "a"))
            pair, which = np.unique(b << 32 | _flat(batch, "a"), return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, which, _flat(batch, "times"))
            columns = [(pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), total, np.bincount(which, minlength=len(pair))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["b", "a", "count", "lists"])

    found = shared.mapped(lists.select("b", "a", "times"), run, "b int, a int, count long, lists long")
    return found.groupBy("b", "a").agg(F.sum("count").alias("count"), F.sum("lists").alias("lists"))


def contributions(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, docs, best, sums): what each block of postings adds to n_best and count_sum of its documents. counts: pair_counts(lists), written.

    A broadcast names the ids that are dealt out to several tasks: at most as many as side B has ids.
    """
    totals = counts.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("a", "count"))).alias("pairs"), F.sum("lists").alias("lists"))  # at most side A's ids a row
    totals = totals.withColumn("tasks", F.ceil(F.col("lists") / SHARE).cast("int"))
    split = totals.filter("tasks > 1").select("b", "tasks")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = totals.select(
        "b", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("turn"), null("long", "chunk"), null("array<int>", "docs"),
        F.col("pairs.a").alias("a"), null("array<int>", "times"), F.col("pairs.count").alias("counts"),
    )
    dealt = lists.join(F.broadcast(split), "b", "left").withColumn("task", F.coalesce(F.pmod(F.xxhash64("chunk"), "tasks").cast("int"), F.lit(0)))
    rest = dealt.select("b", "task", F.lit(1).alias("turn"), "chunk", "docs", "a", "times", null("array<long>", "counts"))
    stream = first.union(rest).repartition("b", "task").sortWithinPartitions("b", "task", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, most = np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        for batch in batches:
            turn = batch.column("turn").to_numpy()
            at = np.concatenate([[0], np.cumsum(_sizes(batch, "a"))])
            count_at = np.concatenate([[0], np.cumsum(_sizes(batch, "counts"))])
            a, counts = _flat(batch, "a"), _flat(batch, "counts")
            each, best = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
            heads = np.flatnonzero(turn == 0)
            starts = heads if len(heads) and heads[0] == 0 else np.concatenate([[0], heads])
            for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(turn)).tolist(), strict=True):
                if lo < hi and turn[lo] == 0:
                    known, count = a[at[lo] : at[lo + 1]], counts[count_at[lo] : count_at[lo + 1]]
                    most, lo = count.max(), lo + 1
                if lo < hi:
                    own = slice(at[lo], at[hi])
                    each[own] = count[np.searchsorted(known, a[own])]
                    best[own] = each[own] == most
            lists_ = np.flatnonzero(turn == 1)
            if len(lists_):
                sizes = np.diff(at)[lists_]
                mine = np.repeat(turn == 1, np.diff(at))
                times = _flat(batch, "times").astype(np.int64)
                cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns = [batch.column("chunk").take(pa.array(lists_)), *(pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (_flat(batch, "docs"), times * best[mine], times * each[mine]))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "docs", "best", "sums"])

    return shared.mapped(stream, run, "chunk long, docs array<int>, best array<long>, sums array<long>")


def summed(parts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of contributions: sums by document, a chunk at a time. A chunk's blocks are a sorted stream, and it has the documents of one Arrow batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sums = -1, np.zeros((2, 0), np.int64)

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(chunk + np.arange(sums.shape[1])), pa.array(sums[0]), pa.array(sums[1])], names=["row", "n_best", "count_sum"])

        for batch in batches:
            owner = batch.column("chunk").to_numpy()
            at = np.concatenate([[0], np.cumsum(_sizes(batch, "docs"))])
            docs, best, more = (_flat(batch, c) for c in ("docs", "best", "sums"))
            cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(owner)).tolist(), strict=True):
                if owner[lo] != chunk:
                    if chunk >= 0:
                        yield given()
                    chunk, sums = int(owner[lo]), np.zeros((2, 0), np.int64)
                own = slice(at[lo], at[hi])
                if (n := int(docs[own].max()) + 1) > sums.shape[1]:
                    sums = np.concatenate([sums, np.zeros((2, n - sums.shape[1]), np.int64)], axis=1)
                np.add.at(sums[0], docs[own], best[own])
                np.add.at(sums[1], docs[own], more[own])
        if chunk >= 0:
            yield given()

    return shared.mapped(parts.repartition("chunk").sortWithinPartitions("chunk"), run, "row long, n_best long, count_sum long")


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per row of docs.

    Side A is a byte-level BPE file over a space and the text, side B a SentencePiece model, which adds that space; neither knows special tokens. Null and empty
    texts, and texts whose bytes side B changes (U+2581 becomes a space), have no tokens: zeros and ''. Ties for the highest count all count as best. Repeated rows
    and null ids are rows of their own, and each counts in the corpus; an empty table gives an empty one; other columns are ignored. A text is encoded whole, in memory.
    """
    rows = shared.picked(docs, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("string"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # numbers that hold from here on, as the next table is written at once
    found = shared.written(postings(rows, path_a, path_b), "align-postings")
    lists = found.filter("b is not null").select("b", "chunk", "docs", "a", "times")
    counts = shared.written(pair_counts(lists), "align-counts")
    sums = summed(contributions(lists, counts))
    own = found.filter("b is null").select("row", "doc_id", *_OWN, "groups_sha256").join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    out = shared.written(own.select("doc_id", *_OWN, *zero, "groups_sha256"), "align-result")
    shared.drop(found, counts)
    return out


def op13_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    """How byte-level BPE and SentencePiece tokens of every document lie to each other."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
