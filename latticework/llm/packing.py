"""Best-fit packing of token sequences by bin completion.

Only how many pieces there are of each length matters for a packing, so pieces are counted by length (at most ``capacity`` counts, whatever the input) and
the search runs on the counts. It takes the largest length left and completes a bin around it: fillings of the room that is left, none dominated by
another (no piece of a filling could be exchanged for a larger one that is left, no room for one more), those with least waste first.

First bins are completed once through: each with the fullest filling, used as often as the counts allow, so there are no more steps than a few for each
length. Best-fit decreasing gives another packing; the better of both is the incumbent, and a packing that meets the lower bound ends the work. Otherwise branch and bound
completes bins anew where an incumbent has waste: its most wasteful bins and some others, a few hundred pieces at a time, are searched over all their undominated
fillings, each used any number of times, and a partial packing whose waste already costs as many bins as the incumbent is dropped. An exchange that saves
bins is made as often as the incumbent has its bins. Where waste is left, fractions() takes any share of a bin: rounding down leaves a rest of about a bin for
each length, whatever the input's size, which is searched the same way. A packing is known to have the fewest bins when it meets lower_bound() or the bound of
the fractions; beyond that the search is bounded (steps, partial fillings around a piece, pivots), so it proves nothing by ending. None of its bounds depends on
the number of pieces.

Pieces then get their places from the layout by their number within their length, which needs two small shuffles and no global order.
"""

from __future__ import annotations

import hashlib
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _text, bpe, shared

CAPACITY = 1024
END_ID = 2
#: Branch and bound looks at bins of so many pieces together, so many times in a row without a better packing, goes on for so many steps from its last better packing on, and looks at so many
#: partial fillings around a piece. These bound the time on the driver; beyond them the best packing so far stands, with its distance from lower_bound().
PIECES, TRIES, STEPS, LOOKS = 240, 8, 400, 300
#: Steps of a search of all bins together.
WHOLE = 3_000
#: Pivots of the fractional packing, fewer for a capacity above CAPACITY; the shares of plain lengths in the worth of pieces by which it looks for patterns, one
#: after the other until there are some; and by how much of their mean, at most, counts are changed at random, so that pivots don't stand still among equal counts.
PIVOTS, SHARES, SHAKEN = 6_000, (0.95, 0.8, 0.5, 0.0), 1e-5
#: Lengths that are tried as the first of three pieces when bins are completed once through.
THIRDS = 64
#: Times that bins are completed once through, with other choices among equal fillings each time; fewer for a capacity above CAPACITY.
ROUNDS = 16
#: Pieces that are numbered together within a length.
NUMBERED = 20_000

Pattern = tuple[tuple[int, int], ...]  # (length, pieces) in a bin


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: each length goes to the fullest bins that hold it. (pattern, bins) of the packing."""
    rooms: dict[int, Counter] = {}
    order: list[int] = []  # the rooms there are, ascending

    def add(room: int, pattern: Pattern, bins: int) -> None:
        if room not in rooms:
            rooms[room] = Counter()
            insort(order, room)
        rooms[room][pattern] += bins

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in order[bisect_left(order, length) :]:
            if not left:
                break
            for pattern, bins in list(rooms[room].items()):
                if not left:
                    break
                each = room // length
                whole = min(bins, left // each)
                parts = [(whole, each)] if whole else []
                if whole < bins and left - whole * each:
                    parts.append((1, min(each, left - whole * each)))
                for n, k in parts:
                    rooms[room][pattern] -= n
                    add(room - k * length, (*pattern, (length, k)), n)
                    left -= n * k
                if not rooms[room][pattern]:
                    del rooms[room][pattern]
            if not rooms[room]:
                del rooms[room]
                order.remove(room)
        if left:
            each = capacity // length
            for n, k in ((left // each, each), (1, left % each)):
                if n and k:
                    add(capacity - k * length, ((length, k),), n)
    return [(p, n) for by in rooms.values() for p, n in by.items() if n]


def fullest(counts: np.ndarray, room: int, rng: random.Random | None = None) -> tuple[int, ...]:
    """An undominated filling of the room (counts: of every length) with least waste: one piece, else two or three without waste, else of any number.

    Of several the one with the largest piece, or any that rng takes.
    """

    def few(room: int) -> tuple[int, ...]:
        if room < 1:
            return ()
        if counts[room]:
            return (room,)
        both = np.flatnonzero(counts[1 : room // 2 + 1] * counts[room - 1 : (room - 1) // 2 : -1]) + 1  # the smaller of two pieces
        if len(both) and 2 * both[-1] == room and counts[both[-1]] < 2:
            both = both[:-1]
        if not len(both):
            return ()
        one = int(both[rng.randrange(len(both)) if rng else 0])
        return room - one, one

    if found := few(room):
        return found
    lengths = (np.flatnonzero(counts[1 : room + 1]) + 1).tolist()
    for length in rng.sample(lengths, min(THIRDS, len(lengths))) if rng else lengths[: -THIRDS - 1 : -1]:
        counts[length] -= 1
        found = few(room - length)
        counts[length] += 1
        if found:
            return length, *found
    own = {k: int(counts[k]) for k in lengths}
    reach = _reached(room, lengths, own)
    room, taken = reach[-1].bit_length() - 1, []
    for end in range(len(lengths), 0, -1):  # no filling that wastes least is dominated
        length = lengths[end - 1]
        k = next(k for k in range(min(own[length], room // length), -1, -1) if reach[end - 1] >> (room - k * length) & 1)
        taken += [length] * k
        room -= k * length
    return tuple(taken)


def completed(counts: dict[int, int], capacity: int, rng: random.Random | None = None) -> list[tuple[Pattern, int]]:
    """(pattern, bins) of bins that are completed once through, around the largest length left."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    packing: list[tuple[Pattern, int]] = []
    largest = capacity
    while largest:
        if not left[largest]:
            largest -= 1
            continue
        left[largest] -= 1
        used = Counter((largest, *fullest(left, capacity - largest, rng)))
        left[largest] += 1
        times = int(min(left[k] // n for k, n in used.items()))
        for k, n in used.items():
            left[k] -= n * times
        packing.append((tuple(used.items()), times))
    return packing


def _reached(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """For every run of smallest lengths the sums up to room that its pieces can reach, as a set of bits."""
    whole = (1 << (room + 1)) - 1
    reach = [1]
    for length in lengths:
        sums, left, k = reach[-1], min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4 .. pieces and the rest
            k = min(k, left)
            sums |= sums << (k * length) & whole
            left, k = left - k, 2 * k
        reach.append(sums)
    return reach


def every_filling(room: int, lengths: list[int], counts: dict[int, int], slack: int, looks: int | None = None, bands: bool = True) -> Iterator[tuple[int, Pattern]]:
    """All undominated fillings of the room that waste at most slack, as (waste, pattern): those of least waste first, then in bands of growing waste, within each
    those of larger pieces first; without bands only the latter. No branch is entered that doesn't end in a filling; looks: so many branches at most.
    """
    reach = _reached(room, lengths, counts)

    def dominated(pattern: Pattern, waste: int) -> bool:
        used = dict(pattern)
        return any(counts[x] > used.get(x, 0) for y in (0, *used) for x in lengths[bisect_right(lengths, y) : bisect_right(lengths, y + waste)])

    start = room
    least = most = start - (reach[-1].bit_length() - 1)
    if not bands:
        most = slack
    while least <= min(slack, start):
        most = min(most, slack)
        stack: list[tuple[int, int, Pattern]] = [(len(lengths), start, ())]
        while stack:
            end, room, taken = stack.pop()
            if looks is not None and (looks := looks - 1) < 0:
                return
            if room < least:
                continue
            end = bisect_right(lengths, room, 0, end)
            low = max(0, room - most)
            if not reach[end] >> low & ((1 << (room - least - low + 1)) - 1):
                continue
            if not end:
                if not room or not dominated(taken, room):
                    yield room, taken
                continue
            length = lengths[end - 1]
            stack.extend((end - 1, room - k * length, (*taken, (length, k)) if k else taken) for k in range(min(counts[length], room // length) + 1))
        least, most = most + 1, most + 4 * (most - least) + 3


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each k, pieces over capacity - k stand alone, those over half share only with pieces of at least k."""
    n = np.zeros(capacity + 2, np.int64)
    for length, c in counts.items():
        n[length] = c
    sums, pieces = np.concatenate([[0], np.cumsum(n * np.arange(capacity + 2))]), np.concatenate([[0], np.cumsum(n)])  # of lengths below each
    half, k = capacity // 2 + 1, np.arange(capacity // 2 + 1)
    large = pieces[half:][0]
    alone, shared_ = pieces[-1] - pieces[capacity - k + 1], pieces[capacity - k + 1] - large
    room = shared_ * capacity - (sums[capacity - k + 1] - sums[half])
    small = sums[half] - sums[k]
    return max(int(-(-sums[-1] // capacity)), int((alone + shared_ + np.maximum(0, -(-(small - room) // capacity))).max(initial=0)))


def _richest(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room the most that pieces within it are worth, of any number, and the place of the last of them in lengths (-1: one unit stays free)."""
    most, last = np.zeros(capacity + 1, worth.dtype), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        most[room] = most[room - 1]
        if n := fit[room]:
            sums = most[room - lengths[:n]] + worth[:n]
            i = sums.argmax()
            if sums[i] > most[room]:
                most[room], last[room] = sums[i], i
    return most, last


def fractions(counts: dict[int, int], capacity: int, patterns: list[Pattern], pivots: int = PIVOTS) -> tuple[list[tuple[Pattern, float]], int]:
    """(pattern, bins) of a packing with fractions of bins, and a lower bound for whole ones: linear programming on patterns, from the given ones on.

    Column generation: a round takes the worth of pieces from the packing at hand and adds for each length the pattern of most worth that has it. Its work depends
    on the number of lengths, not on counts. Fractions are those of the last basis and may miss counts by what SHAKEN changed; the bound is exact at any time.
    """
    lengths = np.array(sorted(counts))
    need, m, at = np.array([counts[k] for k in lengths.tolist()], float), len(lengths), {k: i for i, k in enumerate(lengths.tolist())}
    shaken = need + SHAKEN * need.mean() * np.random.default_rng(0).random(m)
    basis, cost = np.diag((capacity // lengths).astype(float)), np.ones(m)  # a column a pattern; cost 0: a piece too many
    pool = np.zeros((len(patterns), m))
    for row, pattern in zip(pool, patterns, strict=True):
        row[[at[k] for k, _ in pattern]] = [n for _, n in pattern]
    while True:
        inverse = np.linalg.inv(basis)
        x, y = np.maximum(inverse @ shaken, 0), cost @ inverse
        for share in SHARES if not len(pool) else ():
            worth = share * lengths / capacity + (1 - share) * np.maximum(y, 0)
            _, last = _richest(lengths, worth, capacity)
            found = {}
            for j, length in enumerate(lengths.tolist()):
                column, room = np.zeros(m), capacity - length
                column[j] = 1
                while room > 0:
                    if (i := last[room]) >= 0:
                        column[i] += 1
                    room -= int(lengths[i]) if i >= 0 else 1
                if column @ y > 1 + 1e-9:
                    found[column.tobytes()] = column
            if found:
                pool = np.array([*found.values()])
                break
        extra = np.flatnonzero(y < -1e-9)
        if pivots <= 0 or not len(pool) + len(extra):
            break
        price = np.concatenate([np.ones(len(pool)), np.zeros(len(extra))])
        pool = np.concatenate([pool, -np.eye(m)[extra]])
        while pivots > 0:
            gain = pool @ y - price
            if gain[enter := int(gain.argmax())] <= 1e-9:
                break
            change = inverse @ pool[enter]
            rows = np.flatnonzero(change > 1e-7)
            ratio = x[rows] / change[rows]
            step = ratio.min()
            near = rows[ratio <= step * (1 + 1e-12)]
            leave = near[change[near].argmax()]
            x = np.maximum(x - step * change, 0)
            x[leave] = step
            row = inverse[leave] / change[leave]
            rows = np.flatnonzero(change)
            inverse[rows] -= np.outer(change[rows], row)
            inverse[leave] = row
            y = y - gain[enter] * row
            basis[:, leave], cost[leave] = pool[enter], price[enter]
            pivots -= 1
        pool = pool[:0]
    worth = (np.clip(np.nan_to_num(y), 0, 1) * 2.0**40).astype(np.int64)  # any worth gives a bound; whole numbers, so nothing is rounded in it
    most = int(_richest(lengths, worth, capacity)[0][-1])
    bound = -(-sum(w * counts[k] for w, k in zip(worth.tolist(), lengths.tolist(), strict=True)) // most) if most else 0
    x = inverse @ need
    shares = [(tuple((int(lengths[i]), int(basis[i, j])) for i in np.flatnonzero(basis[:, j])), float(x[j])) for j in np.flatnonzero((cost > 0) & (x > 0) & (x <= need.sum()))]
    return shares, bound


def _bins(packing: list[tuple[Pattern, int]]) -> int:
    return sum(n for _, n in packing)


def complete_bins(counts: dict[int, int], capacity: int, steps: int = STEPS, tries: int = TRIES) -> list[tuple[Pattern, int]]:
    """(pattern, bins) of the best packing found. Lengths run from 1 to capacity."""
    counts = {k: n for k, n in counts.items() if n}
    best = _searched(counts, capacity, steps, tries, lower_bound(counts, capacity))
    if _bins(best) <= lower_bound(counts, capacity):
        return best
    try:
        shares, bound = fractions(counts, capacity, [p for p, _ in best], PIVOTS // max(1, capacity // CAPACITY))
    except np.linalg.LinAlgError:  # rounding has made a basis singular
        return best
    if _bins(best) <= bound:
        return best
    left, whole = Counter(counts), []
    for pattern, share in sorted(shares, key=lambda s: -s[1]):
        times = int(share + 1e-6)
        while times and (own := {k: min(n, left[k]) for k, n in pattern if left[k]}):  # a pattern may have a piece too many
            now = min(times, *(left[k] // n for k, n in own.items()))
            whole.append((tuple(own.items()), now))
            left.subtract({k: n * now for k, n in own.items()})
            times -= now
    rest = {k: n for k, n in left.items() if n}
    return min(best, whole + _searched(rest, capacity, steps, tries, bound - _bins(whole)), key=_bins)


def _searched(counts: dict[int, int], capacity: int, steps: int, tries: int, bound: int) -> list[tuple[Pattern, int]]:
    """The best packing that completing bins and branch and bound find; it ends at a packing of lower_bound() or bound."""
    bound = max(bound, lower_bound(counts, capacity))
    best = best_fit(counts, capacity)
    rng, scale = random.Random(0), max(1, capacity // CAPACITY)
    for turn in range(max(1, ROUNDS // scale)):
        if _bins(best) <= bound:
            break
        best = min(best, completed(counts, capacity, rng if turn else None), key=_bins)
    if _bins(best) > bound:  # all bins together, with fillings of larger pieces first
        best = _search_all(counts, capacity, WHOLE, bound, best, False)
    steps = max(50, steps // scale)
    turn = since = 0
    while since < tries and _bins(best) > bound:
        # the most wasteful bins first; from the second turn on half of the pieces are of other bins, every other time those of many pieces above all
        waste = [capacity - sum(k * n for k, n in pattern) for pattern, _ in best]
        size = [sum(n for _, n in pattern) for pattern, _ in best]
        wasteful = sorted(range(len(best)), key=lambda i: (-waste[i] * (rng.random() if turn else 1.0), i))
        others = sorted(range(len(best)), key=lambda i: (-(size[i] if turn % 2 else 1) * rng.random(), i))
        taken, pieces = Counter(), 0
        for order, most in ((wasteful, PIECES // 2 if turn else PIECES), (others, PIECES)):
            for i in order:
                if take := min(best[i][1] - taken[i], max(0, most - pieces) // size[i]):
                    taken[i] += take
                    pieces += take * size[i]
        part: Counter = Counter()
        for i, take in taken.items():
            for k, n in best[i][0]:
                part[k] += n * take
        turn, since = turn + 1, since + 1
        now = [(best[i][0], take) for i, take in taken.items()]
        found = _search_all(dict(part), capacity, steps, lower_bound(part, capacity), now)
        if _bins(found) < _bins(now):
            times = min(best[i][1] // take for i, take in taken.items())  # the same exchange again, as often as there are such bins
            best = [(p, n - taken[i] * times) for i, (p, n) in enumerate(best) if n > taken[i] * times] + [(p, n * times) for p, n in found]
            since = 0
        elif pieces == sum(counts.values()):
            break  # all pieces were in this search, and another would be the same
    return best


def _search_all(counts: dict[int, int], capacity: int, steps: int, bound: int, best: list[tuple[Pattern, int]], bands: bool = True) -> list[tuple[Pattern, int]]:
    """The better of the incumbent and the best packing found; it ends when steps have passed without a better one, or no branch is left.

    Depth first, with all undominated fillings around the largest piece, each taken as often as possible and once (so any number of times). What is left is
    looked at again only if fewer bins were used.
    """
    total, best_bins, left_steps = sum(k * n for k, n in counts.items()), sum(n for _, n in best), steps
    seen: dict[bytes, int] = {}

    def branches(left: dict[int, int], used_bins: int, done: int) -> Iterator[tuple[Pattern, int]]:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        lengths = sorted(k for k, n in rest.items() if n)
        slack = (best_bins - 1) * capacity - total - (used_bins * capacity - done)
        for _, pattern in every_filling(capacity - largest, lengths, rest, slack, LOOKS, bands) if slack >= 0 else ():
            used = Counter(dict(pattern))
            used[largest] += 1
            times = min(left[k] // n for k, n in used.items())
            yield from ((tuple(used.items()), n) for n in sorted({1, times}, reverse=True))

    # each frame: counts left, bins used, sum of their pieces, branches still to try, the packing so far
    stack = [(counts, 0, 0, branches(counts, 0, 0), ())] if counts else []
    while stack and best_bins > bound and left_steps > 0:
        left, bins, done, choices, made = stack[-1]
        if (choice := next(choices, None)) is None or bins * capacity - done > (best_bins - 1) * capacity - total:
            stack.pop()
            continue
        left_steps -= 1
        pattern, times = choice
        rest = dict(left)
        for length, n in pattern:
            rest[length] -= n * times
            if not rest[length]:
                del rest[length]
        bins, done, made = bins + times, done + times * sum(k * n for k, n in pattern), (made, choice)
        if bins * capacity - done > (best_bins - 1) * capacity - total:
            continue
        if not rest:
            packing, node = [], made
            while node:
                node, entry = node
                packing.append(entry)
            best, best_bins, left_steps = packing, bins, steps
            continue
        key = hashlib.blake2b(repr(sorted(rest.items())).encode(), digest_size=16).digest()
        if seen.get(key, bins + 1) > bins:
            seen[key] = bins
            stack.append((rest, bins, done, branches(rest, bins, done), made))
    return best


def layout(packing: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which number on a pattern takes its pieces, and that pattern's first bin, pieces in a bin and offset."""
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    bins = 0
    for pattern, times in packing:
        offset = 0
        for length, each in pattern:
            parts.setdefault(length, []).append((taken[length], bins, each, offset))
            taken[length] += each * times
            offset += length * each
        bins += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in parts.items()}


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str, text: str, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): whole documents, or pieces of capacity tokens of which the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in batches:
            data, offs = _text.text_bytes(batch.column(1))
            for i, j, d, o in _text.chunks(data, offs, bpe.CHUNK_BYTES):
                ids, at = coder.encode(d, o)
                at = at + np.arange(j - i + 1)
                full = np.full(at[-1], end_id, "<u4")
                body = np.ones(at[-1], bool)
                body[at[1:] - 1] = False
                full[body] = ids
                size = np.diff(at)
                first = np.where(size <= capacity, size, (size - 1) % capacity + 1)
                n = 1 + (size - first) // capacity
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                raw, begin = memoryview(full.tobytes()), ((at[doc] + start) * 4).tolist()
                crc = [zlib.crc32(raw[b : b + 4 * k]) for b, k in zip(begin, length.tolist(), strict=True)]
                arrays = [
                    batch.column(0).slice(i, j - i).take(pa.array(doc)),
                    *(pa.array(x) for x in (piece.astype(np.int32), start, length)),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:  # pieces follow one another, so do their ids
                    cuts = np.append((at[doc] + start), at[-1]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = shared.picked(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))
    return shared.mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A document is its ids and end_id; null text counts as empty. Documents longer than capacity are cut into pieces of capacity tokens, the first may be
    shorter. Sequences hold at most capacity tokens, pieces lie one after the other from offset 0 on. Repeated rows are packed each; null ids too.
    An empty table gives no rows. Other columns are ignored. path: a tokenizer file, at the same place on every executor.
    """
    spark = docs.sparkSession
    cut = shared.written(pieces(docs, path, capacity, end_id, doc_id, text, with_ids), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(layout(complete_bins(counts, capacity)))

    # a number within each length: hashed groups are numbered each, and begin where the groups before them end
    groups = max(64, -(-sum(counts.values()) // NUMBERED))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "group").orderBy("doc_id", "piece")
    numbered = dealt.withColumn("number", F.row_number().over(within) - 1).join(firsts, ["length", "group"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("base")).select(*cut.columns, "number")
    columns = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, number = (batch.column(k).to_numpy() for k in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                taken, first, each, begin = table[int(k)]
                at = np.searchsorted(taken, number[rows], "right") - 1
                own = number[rows] - taken[at]
                sequence[rows] = first[at] + own // each[at]
                offset[rows] = begin[at] + own % each[at] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return shared.mapped(numbered, place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' pieces and their places in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
