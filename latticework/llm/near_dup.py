"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of five-word shingles. Equal sets are one class, joined by one representative (its smallest id); only representatives go on.

* Every representative gets 128 minwise values and from them a sketch of two bits each.
* A tree starts with all representatives at its root. A node chooses two of the 128 positions, by a hash of its path, and sends each member to the
  child named by its minwise value there. A pair of similarity s meets in a child with probability s per position, so at s = 0.75 a tree of any depth
  loses the pair with probability 1/9 at most (the smaller root of q = (1/4 + 3q/4)^2), and six independent trees lose it with less than 2e-6. The trees choose
  from the same 128 functions, so they are independent only nearly; recall is measured against brute force.
* First every member of a first-level node is compared with the node's pivot, its smallest id. Confirmed links join most copies to one component at once.
* Then only nodes that still hold two components matter. ``nearest`` times every member of a first-level node is compared with the most similar member of
  another component in its block (of 2 * ``block`` members) of the node, which joins what is left of large groups of copies.
* Nodes of more than ``dense`` members that still hold two components are mostly documents around something common, a passage or a template, just too unlike to
  be linked; branching such a node by similarity hardly makes it smaller, and its pairs grow with its square. They are resolved by their rare shingles first
  (``_resolved``), in work that grows with their words, and of their members only those stay that could be linked by common shingles alone.
* Of the nodes that still hold two components, those of at most ``leaf`` members are compared exhaustively, across components only, in pairs of blocks of
  ``block`` members; larger ones are branched again. Nodes still large at the last depth are compared in the same way. Where a pair of blocks has more than
  two possible links a row (say, short documents around one common passage), it isn't the pairs that are handed on but the rows, and whole sets are
  compared by one matrix product; only links that join components come out.
* Sizes and sketches only spare comparisons: a pair goes on unless its sizes alone rule it out, or it disagrees in more than 46 of 128 sketch fields
  (five standard deviations at similarity 0.75).
  Every link is confirmed on the full sets, from the texts.

No pair within a component is enumerated, no node's members meet in one task unless they are few, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text, shared

POSITIONS = 128
SHINGLE = 5

_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 62, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHTS = [np.uint64(int(x) * 2 + 1) for x in _RNG.integers(0, 1 << 62, SHINGLE)]
_SKETCH = ["s0", "s1", "s2", "s3"]
_CARRY = ["n", *_SKETCH]


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, end to end, and each text's offsets among them."""
    starts, ends, at = _text.words(data, offs)
    h = _text.hashes(_text.lowered(data), starts, ends)
    n, count = len(h), np.diff(at)
    shingles = np.zeros(n, np.uint64)
    texts = _text.owners(at)
    left = at[1:][texts] - np.arange(n)  # words from here to the text's end
    for k in range(SHINGLE):
        there = left > k
        shingles[there] += h[k:][there[: n - k] if k else there] * _WEIGHTS[k] if k < n else np.uint64(0)
    used = np.minimum(left, SHINGLE).astype(np.uint64)
    shingles = _text.mix(shingles + used)
    whole = (left >= SHINGLE) | ((count[texts] < SHINGLE) & (np.arange(n) == at[:-1][texts]))
    shingles, texts = shingles[whole], texts[whole]
    first = np.unique(_text.mix(shingles + _text.mix(texts.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    first.sort()
    return shingles[first], np.searchsorted(texts[first], np.arange(len(offs)))


def minwise(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """POSITIONS minwise values (uint32) of each non-empty set; zeros for an empty one."""
    out = np.zeros((len(at) - 1, POSITIONS), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        begin = at[:-1][full]
        for k in range(POSITIONS):
            out[full, k] = np.minimum.reduceat((((sets ^ _XOR[k]) * _MUL[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """Two bits of each minwise value, as four 64-bit words."""
    bits = ((values.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(30)) & np.uint64(3)
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(bits.reshape(-1, 4, 32) << shifts, axis=2).view(np.int64)


def _set_keys(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that name a set whatever the order of its shingles."""
    keys = []
    for salt in (0x1234567, 0x89ABCDEF):
        sums = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(_text.mix(sets ^ np.uint64(salt)), out=sums[1:])
        keys.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return keys


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, minwise, s0 .. s3) of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = _text.text_bytes(batch.column(1))
            for i, j, d, o in _text.chunks(data, offs):
                sets, at = shingle_sets(d, o)
                values = minwise(sets, at)
                bits = sketches(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(at)),
                        *(pa.array(k) for k in _set_keys(sets, at)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * POSITIONS), j - i, [None, pa.py_buffer(values.tobytes())]).cast(pa.binary()),
                        *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "minwise", *_SKETCH],
                )

    return shared.mapped(docs, run, "doc_id long, n_shingles long, k1 long, k2 long, minwise binary, s0 long, s1 long, s2 long, s3 long")


def _branch(members: DataFrame, keep: list[str]) -> DataFrame:
    """The two children of each (node, member) row."""
    first = F.expr(f"pmod(xxhash64(node, 1), {POSITIONS})")
    second = F.expr(f"pmod(pmod(xxhash64(node, 1), {POSITIONS}) + 1 + pmod(xxhash64(node, 2), {POSITIONS - 1}), {POSITIONS})")
    child = F.expr("xxhash64(node, position, substring(minwise, cast(4 * position + 1 as int), 4))")
    return members.withColumn("position", F.explode(F.array(first, second))).withColumn("node", child).select("node", *keep)


def _disagree(left: list[str], right: list[str]) -> F.Column:
    """In how many of the sketch fields two sketches differ."""
    parts = [f"bit_count(({a} ^ {b} | shiftrightunsigned({a} ^ {b}, 1)) & {0x5555555555555555})" for a, b in zip(left, right, strict=True)]
    return F.expr(" + ".join(parts))


def _alike(left: str, right: str, percent: int) -> F.Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least(left, right) >= percent * F.greatest(left, right)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key; a group never ends up in two tables."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = table.column(key).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def _compared(nodes: DataFrame, most: int, percent: int, best_only: bool) -> DataFrame:
    """What may be linked within groups of few rows, across components, by sizes and sketches. nodes: (node, id, comp, n, s0 .. s3).

    best_only: for each row the pair (a, b) with its most similar row. Else all such pairs of groups with few of them; for groups with more than two a
    row, rows (a: id, b: component, node) of those that are in a pair, to be compared on whole sets together. Either way no more than two rows per row.
    """
    odd = np.uint64(0x5555555555555555)

    def found(table: pa.Table) -> pa.RecordBatch:
        node, ids, comp, n = (table.column(k).to_numpy() for k in ("node", "id", "comp", "n"))
        bits = np.stack([table.column(k).to_numpy() for k in _SKETCH]).view(np.uint64)
        left, right, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, len(node)):
            at = np.flatnonzero(node[d:] == node[:-d])
            if not len(at):
                break
            at = at[(comp[at] != comp[at + d]) & (100 * np.minimum(n[at], n[at + d]) >= percent * np.maximum(n[at], n[at + d]))]
            x = bits[:, at] ^ bits[:, at + d]
            off = np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(axis=0)
            at, off = at[off <= most], off[off <= most]
            left.append(at)
            right.append(at + d)
            score.append(off.astype(np.int64))
        i, j, off = np.concatenate(left), np.concatenate(right), np.concatenate(score)
        group, members = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if best_only:
            own, other, off = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([off, off])
            by = np.lexsort((ids[other], off, own))
            first = np.unique(own[by], return_index=True)[1]
            i, j = own[by][first], other[by][first]
        else:
            every, which, rows = np.unique(node, return_inverse=True, return_counts=True)
            dense = (np.bincount(which[i], minlength=len(every)) > 2 * rows)[which[i]]
            members = np.unique(np.concatenate([i[dense], j[dense]]))
            group = node[members]
            i, j = i[~dense], j[~dense]
        pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
        none = np.zeros(pairs.shape[1], bool)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([pairs[0], ids[members]])),
                pa.array(np.concatenate([pairs[1], comp[members]])),
                pa.array(np.concatenate([np.zeros(len(none), np.int64), group]), mask=np.concatenate([~none, np.zeros(len(group), bool)])),
            ],
            names=["a", "b", "node"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "node"):
            yield found(table)

    rows = nodes.select("node", "id", "comp", *_CARRY).repartition("node").sortWithinPartitions("node")
    return shared.mapped(rows, run, "a long, b long, node long")


def _marked(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with nd_maybe: false only where key isn't in ids (doc_id, distinct), mostly true where it is, and null never.

    A table of 64-bit words, three bits an id, goes to all tasks. It has one word for four ids, but 2^20 words at most: its size is bounded, and beyond
    some millions of ids it merely lets more rows through. So an exact join with ids need only shuffle the rows that are marked.
    """
    words = min(1 << 20, max(64, 1 << (ids.count() // 4).bit_length()))

    def word_and_mask(name: str) -> tuple[F.Column, F.Column]:
        own, mask = F.col(name).cast("long"), F.lit(0).cast("long")
        for k in range(3):
            spot = F.shiftright(F.xxhash64(own, F.lit(1)), 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), spot))
        return F.pmod(F.xxhash64(own), F.lit(words)), mask

    word, mask = word_and_mask("doc_id")
    table = ids.select(word.alias("nd_word"), mask.alias("mask")).groupBy("nd_word").agg(F.expr("bit_or(mask)").alias("nd_bits"))
    word, mask = word_and_mask(key)
    joined = docs.withColumn("nd_word", word).join(F.broadcast(table), "nd_word", "left")
    return joined.withColumn("nd_maybe", F.coalesce(F.col("nd_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("nd_word", "nd_bits")


def _texts(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of docs whose doc_id is in ids (distinct), as a written table."""
    some = _marked(docs, ids).filter("nd_maybe").select("doc_id", "text")
    return shared.written(some.join(ids, "doc_id", "left_semi"), name)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union. docs: (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [_text.text_bytes(batch.column(k)) for k in (2, 3)]
            n, i, out = batch.num_rows, 0, []
            total = sides[0][1] + sides[1][1]
            while i < n:
                j = max(i + 1, int(np.searchsorted(total, total[i] + _text.CHUNK_BYTES, "right")) - 1)
                keys, sizes = [], []
                for data, offs in sides:
                    sets, at = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    sizes.append(np.diff(at))
                    keys.append(_text.mix(sets + _text.mix(_text.owners(at).astype(np.uint64) + np.uint64(1))))
                row = np.concatenate([np.repeat(np.arange(j - i), s) for s in sizes])
                both = np.concatenate(keys)
                order = np.argsort(both)
                twice = np.flatnonzero(both[order][1:] == both[order][:-1])
                common = np.bincount(row[order[twice]], minlength=j - i)
                out.append(100 * common >= percent * (sizes[0] + sizes[1] - common))
                i = j
            good = pa.array(np.concatenate(out)) if out else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(good)

    ids = shared.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    texts = _texts(docs, ids, f"{name}-texts")
    rows = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    links = shared.written(shared.mapped(rows, run, "a long, b long").distinct(), f"{name}-links")
    shared.drop(texts, ids)
    return links


def _confirmed_groups(members: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (a, b) that join what is linked on whole sets within groups (a: id, b: component, node): a spanning forest, no more links than rows."""

    def forest(table: pa.Table) -> tuple[list[int], list[int]]:
        ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
        data, offs = _text.text_bytes(table.column("text"))
        parts = [shingle_sets(d, o) for _, _, d, o in _text.chunks(data, offs)]
        sets, at = np.concatenate([s for s, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in parts]))])
        del parts
        own, size = _text.owners(at), np.diff(at).astype(float)
        shingle, which, count = np.unique(sets, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        held = count[which] > 1
        common = np.zeros((len(ids), len(ids)))
        row, col = own[held], number[which[held]]
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 8192):
            part = (col >= lo) & (col < lo + 8192)
            grid = np.zeros((len(ids), 8192), np.float32)
            grid[row[part], col[part] - lo] = 1
            common += grid @ grid.T
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        linked &= comp[:, None] != comp[None, :]
        root = {int(c): int(c) for c in comp}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        left, right = [], []
        for i, j in np.argwhere(np.triu(linked, 1)).tolist():
            if (x := find(int(comp[i]))) != (y := find(int(comp[j]))):
                root[max(x, y)] = min(x, y)
                left.append(int(ids[i]))
                right.append(int(ids[j]))
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "node"):
            keys = table.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            left, right = [], []
            for i, j in zip(cuts, cuts[1:]):
                a, b = forest(table.slice(i, j - i))
                left += a
                right += b
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    ids = shared.written(members.select(F.col("a").alias("doc_id")).distinct(), f"{name}-ids")
    texts = _texts(docs, ids, f"{name}-texts")
    rows = members.select(F.col("a").alias("id"), F.col("b").alias("comp"), "node").join(texts.withColumnRenamed("doc_id", "id"), "id")
    rows = rows.select("node", "id", "comp", "text").repartition("node").sortWithinPartitions("node")
    links = shared.written(shared.mapped(rows, run, "a long, b long").distinct(), f"{name}-links")
    shared.drop(texts, ids)
    return links


def _spots(shingles: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a bit table that a shingle has, and its three bits there."""
    h, one = _text.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(1)
    mask = one << (h & np.uint64(63)) | one << (h >> np.uint64(6) & np.uint64(63)) | one << (h >> np.uint64(12) & np.uint64(63))
    return (h >> np.uint64(40) & np.uint64(words - 1)).astype(np.int64), mask


def _bit_table(shingles: DataFrame) -> np.ndarray:
    """A table of bits that all these shingles (a written table) are in, and few others while they are not many millions: 2^20 words (8 MB) at most."""
    words = min(1 << 20, max(64, 1 << (shingles.count() // 4).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(words, np.uint64)
        for batch in batches:
            np.bitwise_or.at(table, *_spots(batch.column(0).to_numpy().view(np.uint64), words))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used].view(np.int64))], names=["word", "bits"])

    found = shared.mapped(shingles.select("shingle"), run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    table = np.zeros(words, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _in_table(table: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    word, mask = _spots(shingles, len(table))
    return table[word] & mask == mask


def _over_sets(texts: DataFrame, made, schema: str) -> DataFrame:
    """Rows that made(ids, comps, sets, offsets) gives of chunks of texts (id, comp, text), as a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, comps = (batch.column(k).to_numpy() for k in (0, 1))
            data, offs = _text.text_bytes(batch.column(2))
            for i, j, d, o in _text.chunks(data, offs):
                columns = made(ids[i:j], comps[i:j], *shingle_sets(d, o))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return shared.mapped(texts, run, schema)


def _counted(ids: np.ndarray, comps: np.ndarray, sets: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of each shingle of a chunk its documents, and their smallest and largest component."""
    order = np.argsort(sets, kind="stable")
    first = np.flatnonzero(np.append(True, sets[order][1:] != sets[order][:-1])) if len(sets) else np.zeros(0, np.int64)
    comp = comps[_text.owners(at)][order]
    lo, hi = (f.reduceat(comp, first) if len(first) else comp for f in (np.minimum, np.maximum))
    return {"shingle": sets[order][first].view(np.int64), "members": np.diff(np.append(first, len(sets))), "lo": lo, "hi": hi}


def _meeting(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of (shingle, id, comp) that share a shingle and not a component; for shingles that few ids have."""

    def found(table: pa.Table) -> pa.RecordBatch:
        shingle, ids, comp = (table.column(k).to_numpy() for k in ("shingle", "id", "comp"))
        pairs = [np.zeros((2, 0), np.int64)]
        for d in range(1, len(shingle)):
            at = np.flatnonzero(shingle[d:] == shingle[:-d])
            if not len(at):
                break
            at = at[comp[at] != comp[at + d]]
            pairs.append(np.sort(np.stack([ids[at], ids[at + d]]), axis=0))
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "shingle"):
            yield found(table)

    return shared.mapped(rows.select("shingle", "id", "comp").repartition("shingle").sortWithinPartitions("shingle"), run, "a long, b long").distinct()


def _resolved(members: DataFrame, docs: DataFrame, percent: int, rare: int, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Of large nodes (node, id, comp, n, s0 .. s3): links (a, b) across components, and the (node, id) that are still to be compared.

    Only shingles that two components have can make a link; call those that more than ``rare`` members have common (and a few others, which a bit table of bounded
    size takes for such). Two linked members either share a shingle that isn't common, and such pairs are found by it (at most ``rare`` members a shingle, then by sizes,
    sketches and whole sets); or their common shingles alone are enough, so both have so many that for sizes x and y, common >= percent / (100 + percent) * (x + y).
    Members with fewer are done. Of those with the very same common shingles the smallest is linked to all that can be linked to any of them; the others go on only if
    their node has a member small enough for the bound. So nothing is missed. Of the members' words only counts of shingles are shuffled, summed by chunk, and the rare ones.
    """
    ids = shared.written(members.select(F.col("id").alias("doc_id"), "comp", *_CARRY).distinct(), f"{name}-ids")
    some = _marked(docs, ids.select("doc_id")).filter("nd_maybe").select("doc_id", "text")
    texts = some.join(ids.select("doc_id", "comp"), "doc_id").select(F.col("doc_id").alias("id"), "comp", "text")
    texts = shared.written(texts, f"{name}-texts")
    counts = _over_sets(texts, _counted, "shingle long, members long, lo long, hi long").groupBy("shingle")
    counts = counts.agg(F.sum("members").alias("members"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("shingle", "members")
    counts = shared.written(counts, f"{name}-counts")
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast([_bit_table(counts.filter(F.col("members") > rare)), _bit_table(counts.filter(F.col("members") <= rare))])

    def sparse(own: np.ndarray, comps: np.ndarray, sets: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        use = _in_table(tables.value[1], sets) & ~_in_table(tables.value[0], sets)
        row = _text.owners(at)[use]
        return {"shingle": sets[use].view(np.int64), "id": own[row], "comp": comps[row]}

    def known(own: np.ndarray, comps: np.ndarray, sets: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        use = _in_table(tables.value[0], sets)
        cuts = np.concatenate([[0], np.cumsum(use)])[at]
        c1, c2 = _set_keys(sets[use], cuts)
        return {"id": own, "comp": comps, "n": np.diff(at), "common": np.diff(cuts), "c1": c1, "c2": c2}

    pairs = _meeting(_over_sets(texts, sparse, "shingle long, id long, comp long"))
    for side in "ab":
        pairs = pairs.join(ids.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}{c}") for c in _CARRY)), side)
    sketches_ = ([f"{side}{c}" for c in _SKETCH] for side in "ab")
    pairs = pairs.filter(_alike("an", "bn", percent) & (_disagree(*sketches_) <= most)).select("a", "b")

    common = _over_sets(texts, known, "id long, comp long, n long, common long, c1 long, c2 long").filter(100 * F.col("common") >= percent * F.col("n"))
    common = shared.written(common, f"{name}-common")
    first = common.groupBy("c1", "c2").agg(F.min(F.struct("n", "id", "comp")).alias("first"))
    told = common.join(first, ["c1", "c2"]).select("id", "comp", "common", "n", "first")
    told = told.withColumn("near", (100 + percent) * F.col("common") >= percent * (F.col("n") + F.col("first.n")))
    told = shared.written(told, f"{name}-told")
    stars = told.filter(F.col("near") & (F.col("comp") != F.col("first.comp"))).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    links = confirmed(shared.written(pairs.union(stars), f"{name}-pairs"), docs, percent, name)

    left = told.filter(~F.col("near") | (F.col("id") == F.col("first.id"))).select("id", "n", "common")
    there = members.select("node", "id").join(left, "id")
    least = there.groupBy("node").agg(F.min("n").alias("least"))
    keep = shared.written(there.join(least, "node").filter((100 + percent) * F.col("common") >= percent * (F.col("n") + F.col("least"))).select("node", "id"), f"{name}-left")
    tables.destroy()
    shared.drop(ids, counts, texts, common, told)
    return links, keep


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, comp) of every id in links (a, b): comp is the smallest id it reaches.

    Labels take the smallest label among neighbours, then follow that label's own label, so paths halve each time. Each round is a written table.
    """
    both = shared.written(links.select("a", "b").union(links.select("b", "a")), f"{name}-edges")
    labels = shared.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = shared.written(labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), f"{name}-step")
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        after = shared.written(step.join(jump, "comp").select("id", "was", F.least("comp", "root").alias("comp")), f"{name}-labels")
        changed = after.filter("was <> comp").limit(1).count()
        shared.drop(labels, step)
        labels = after.select("id", "comp")
        if not changed:
            shared.drop(both)
            return labels


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 75,
    trees: int = 6,
    leaf: int = 1024,
    block: int = 256,
    dense: int = 1024,
    rare: int = 32,
    nearest: int = 1,
    depth: int = 16,
    most: int = 46,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs of other than space and \\t..\\r; a set holds the distinct five-word shingles, with fewer words the whole sequence.
    Documents with 100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable; kept: doc_id = component_id.
    Null or wordless texts: empty set, linked with nothing, kept. Null doc_ids: the component of their equals; never kept.
    Rows of one doc_id are one node of the graph. Other columns are ignored. An empty table gives an empty one. A text is taken whole, in memory.
    Keys that very many rows share (copies of one text, a node, a component) are joined with written tables only, so that Spark's skew join splits them.
    """
    rows = shared.picked(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = shared.written(signatures(rows), "nd-signed")
    classes = shared.written(
        signed.filter("n_shingles > 0")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("minwise").alias("minwise"), *(F.first(s).alias(s) for s in _SKETCH)),
        "nd-classes",
    )
    reps = classes.filter("id is not null").select("id", "minwise", *_CARRY)

    roots = reps.withColumn("node", F.explode(F.array(*(F.lit(t).cast("long") for t in range(trees)))))
    members = _branch(roots, ["id", *_CARRY])
    pivots = (
        members.groupBy("node")
        .agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot"), *(F.min_by(s, "id").alias(f"p{s}") for s in _CARRY))
        .filter("size > 1")
    )
    pivots = shared.written(pivots, "nd-pivots")  # a table, so that Spark can split the nodes with very many members in the join
    shared_nodes = shared.written(members.join(pivots, "node"), "nd-nodes")
    stars = (
        shared_nodes.filter((F.col("id") != F.col("pivot")) & _alike("n", "pn", percent) & (_disagree(_SKETCH, [f"p{s}" for s in _SKETCH]) <= most))
        .select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    stars = shared.written(stars, "nd-stars")
    links = confirmed(stars, rows, percent, "nd-stars")
    labels = components(links, "nd-stars")

    def in_blocks(nodes: DataFrame, size: int, pairs: bool) -> DataFrame:
        """Groups of few rows: a node's blocks, each alone or every pair of them, so that any two members meet."""
        blocks = F.ceil(F.col("size") / size)
        cut = nodes.withColumn("own", F.pmod(F.xxhash64("id", "node"), blocks))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)) if pairs else F.col("own"))
        return cut.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).select("node", "id", "comp", *_CARRY)

    def mixed(nodes: DataFrame) -> DataFrame:
        """Rows of nodes that hold two components, with the node's size."""
        counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        counts = shared.written(counts.select("node", "size"), "nd-mixed")
        small.append(counts)
        return nodes.join(counts, "node")

    def labelled(nodes: DataFrame) -> DataFrame:
        return nodes.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    small: list[DataFrame] = []
    first_level = shared_nodes.select("node", "id", *_CARRY)
    for turn in range(nearest):
        near = shared.written(_compared(in_blocks(mixed(labelled(first_level)), 2 * block, False), most, percent, True).select("a", "b").distinct(), f"nd-near{turn}")
        links = links.union(confirmed(near, rows, percent, f"nd-near{turn}"))
        shared.drop(near, labels)
        labels = components(links, f"nd-near{turn}")

    open_nodes, leaves, levels = labelled(first_level), [], []
    held = shared.written(mixed(open_nodes), "nd-first")
    levels.append(held)
    large = held.filter(F.col("size") > dense)
    if large.limit(1).count():
        more, keep = _resolved(large, rows, percent, rare, most, "nd-dense")
        links = links.union(more)
        shared.drop(labels)
        labels = components(links, "nd-dense")
        levels.append(keep)
        stay = held.filter(F.col("size") <= dense).union(large.join(keep, ["node", "id"], "left_semi").select(*held.columns))
        open_nodes = labelled(stay.select("node", "id", *_CARRY))
    else:
        open_nodes = held.drop("size")
    for level in range(1, depth + 1):
        held = shared.written(mixed(open_nodes), f"nd-level{level}")
        levels.append(held)
        large = held.filter(F.col("size") > leaf)
        if level == depth or not large.limit(1).count():
            leaves.append(held.select("node", "size", "id", "comp", *_CARRY))
            break
        leaves.append(held.filter(F.col("size") <= leaf).select("node", "size", "id", "comp", *_CARRY))
        if "minwise" not in large.columns:
            large = large.join(reps.select("id", "minwise"), "id")
        open_nodes = _branch(large, ["id", "comp", "minwise", *_CARRY])
    found = shared.written(_compared(in_blocks(reduce(DataFrame.union, leaves), block, True), most, percent, False), "nd-found")
    links = links.union(confirmed(found.filter("node is null").select("a", "b").distinct(), rows, percent, "nd-pairs"))
    links = links.union(_confirmed_groups(found.filter("node is not null"), rows, percent, "nd-groups"))
    shared.drop(labels)
    labels = components(links, "nd-all")
    shared.drop(shared_nodes, pivots, stars, links, found, *levels, *small)

    named = shared.written(
        classes.select("k1", "k2", "id").join(labels, "id", "left").select("k1", "k2", F.coalesce("comp", "id").alias("component_id")), "nd-components"
    )
    shared.drop(classes, labels)
    full = signed.filter("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = full.union(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    found = shared.written(found, "nd-result")  # four small columns, so that the signatures can go
    shared.drop(signed, named)
    return found


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """n_shingles, component_id and kept of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near-duplicates the document with the smallest id, with all columns of docs as they are.

    Rows of one doc_id stay or go together; rows without doc_id stay, as do documents without words. An empty table gives an empty one.
    """
    gone = shared.written(near_duplicates(docs).filter("doc_id is not null and not kept").select("doc_id").distinct(), "nd-gone")
    rows, key = shared.numbered(docs), f"c{shared.position(docs, 'doc_id')}"
    marked = _marked(rows, gone, key)
    maybe = marked.filter("nd_maybe").join(gone, F.col(key).cast("long") == F.col("doc_id"), "left_anti")
    return marked.filter("not nd_maybe").drop("nd_maybe").union(maybe.drop("nd_maybe")).toDF(*docs.columns)
