"""Search, near-duplicates, packing, URLs, chat and archives against brute force, and the edges that the docstrings define."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import os
import pytest
from pyspark.sql import functions as F

from latticework.llm import bm25, chat, near_dup, packing, queries, shared, urls, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{DATA}/{table}'")
    got = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    common = collections.Counter()
    for ks in where.values():
        for a in range(len(ks)):
            for b in range(a):
                common[ks[b], ks[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((find(sets[a][0]), find(sets[b][0])))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def planted(seed=4):
    """Texts with chains of copies, one group of many near copies, short boilerplate texts and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    base = [word() for _ in range(60)]
    for _ in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = word()
        texts.append(" ".join(own))
    head = " ".join(word() for _ in range(13))
    texts += [head + "\n" + " ".join(word() for _ in range(rng.randint(1, 7))) for _ in range(200)]
    for _ in range(60):
        own = [word() for _ in range(rng.randint(5, 80))]
        for _ in range(4):
            own = list(own)
            own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own).upper() if rng.random() < 0.3 else " ".join(own))
    texts += ["", None, " \n", "one two", "ONE  two", "one two three four five", texts[0], texts[0]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("options", [{}, {"leaf": 64, "block": 16, "depth": 3}, {"dense": 8, "rare": 4}, {"dense": 2, "rare": 1, "leaf": 16, "block": 8}])
def test_near_duplicates_are_all_found(spark, options):
    rows = planted()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, **options).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 300


def template_rows(n, seed=3):
    """Documents around three passages of 100 words with 36, 21 and 17 words of their own (similarity 0.55 to 0.74), some with fewer, some one word apart, some with a passage that is torn."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for own in (36, 21, 17):
        head = [word() for _ in range(100)]
        for i in range(n):
            mine = list(head)
            if i % 40 == 1:
                mine[rng.randrange(100)] = word()
            texts.append(" ".join([*mine, *(word() for _ in range(own if i % 50 else rng.randint(3, own)))]))
        texts += [texts[-1 - 7 * k] + " end" for k in range(n // 40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_templates_are_resolved_by_rare_shingles(spark):
    rows = template_rows(700)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dup.near_duplicates(docs, dense=128).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_rows_compared_grow_with_documents(spark, monkeypatch):
    """Documents around a passage, just too unlike to be linked: a few rows each are compared, however many documents there are."""
    plain, meeting, each = near_dup._compared, near_dup._meeting, []
    seen = []
    monkeypatch.setattr(near_dup, "_compared", lambda nodes, *a: (seen.append(nodes.count()), plain(nodes, *a))[1])
    monkeypatch.setattr(near_dup, "_meeting", lambda rows: (seen.append(rows.count()), meeting(rows))[1])
    for n in (500, 2000):
        seen.clear()
        rows = template_rows(n, n)
        near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        each.append(sum(seen) / len(rows))
    assert max(each) < 50 and each[1] < 1.3 * each[0]


def test_long_texts_in_large_nodes(spark):
    """Texts of 30,000 words around common ones, one of them a near copy of another."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    rows = [(i, " ".join([*words[: 24_000], *(f"x{i}y{k}" for k in range(9_000))])) for i in range(12)]
    rows.append((12, rows[5][1] + " and more"))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), dense=4, rare=3).collect()}
    assert got == {**{i: i for i in range(12)}, 12: 5}


def test_near_duplicates_on_documents_and_edges(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = near_dup.op3_near_duplicates(spark, DATA).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "x"), (8, "q"), (8, "q")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dup.near_duplicates(odd).collect()) == [
        ("7", "7", True), ("8", "8", True), ("8", "8", True), ("None", "7", False), ("None", "None", False),
    ]


def brute_search(rows, asked, k):
    docs = [(i, collections.Counter(WORD.findall(lower(t)))) for i, t in rows]
    df = collections.Counter(w for _, c in docs for w in c)
    mean = max(1.0, sum(sum(c.values()) for _, c in docs) / len(docs))
    out = {}
    for q, text in asked:
        terms, scored = collections.Counter(WORD.findall(lower(text))), []
        for i, c in docs:
            size, total = sum(c.values()), 0
            for w, n in terms.items():
                if c[w]:
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    total += n * math.floor(1e6 * (idf * (c[w] * 2.2) / (c[w] + 1.2 * (1 - 0.75 + 0.75 * size / mean))) + 0.5)
            if total > 0:
                scored.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_search_is_exact(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "to"] * 30 + [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(600)] + [(600, None), (601, "the the The")]
    rows += [(700 + i, rows[5][1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(q, rows[q][1]) for q in range(0, 600, 40)] + [(9001, ""), (9002, "unknownword"), (9003, None)]
    terms = bm25.query_terms(spark.createDataFrame(asked, "query_id long, text string"))
    index = shared.written(bm25.build_index(docs), "test-index")
    want = brute_search(rows, asked, 7)
    for limit in (1_000_000, 100):
        got = collections.defaultdict(list)
        for r in bm25.search(index, terms, 7, limit).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["doc_id"], round(r["score"] * 1e6)))
        assert dict(got) == {q: v for q, v in want.items() if v}
    empty = shared.written(bm25.build_index(docs.limit(0)), "test-index")
    assert bm25.search(empty, terms).count() == 0 and bm25.search(index, terms.limit(0)).count() == 0


def test_search_in_tasks_of_several_shards(spark, monkeypatch):
    """Small shards, several in a task, thresholds from a shard searched beforehand, few queries at a time; a long text alone in its shard."""
    for name, value in (("SHARD_DOCS", 20), ("SHARD_WORDS", 2000), ("SEED_FILES", 2), ("WORK", 500), ("BLOCK_QUERIES", 7), ("FIRST_PIVOTS", 1)):
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(12)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    rows += [(400, " ".join(rng.choice(vocabulary) for _ in range(200_000))), (401, rows[3][1]), (401, rows[3][1])]
    asked = [(q, rows[q][1]) for q in range(0, 400, 25)] + [(400, rows[400][1]), (402, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    index = shared.written(bm25.build_index(docs), "test-index")
    assert index.count() > 16
    got = collections.defaultdict(list)
    for r in bm25.search(index, bm25.query_terms(spark.createDataFrame(asked, "query_id long, text string")), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"] * 1e6)))
    assert dict(got) == {q: v for q, v in brute_search(rows, asked, 5).items() if v}


def test_index_files_hold_little_at_once(spark, monkeypatch, tmp_path):
    """One task writes 40 shards of 0.35 MB: writers and readers hold a row group whole, and statistics of binary columns until a file is closed."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(bm25, "SHARD_DOCS", 10)
    monkeypatch.setattr(shared, "drop", lambda *tables: None)
    before = set(glob.glob(shared.folder(spark).removeprefix("file://") + "/bm25-index-*"))
    words = "concat_ws(' ', transform(sequence(1, 1200), x -> cast(id * 1200 + x AS string)))"
    spark.range(400).coalesce(1).selectExpr("id AS doc_id", f"{words} AS text").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["query_id"], r["doc_id"]) for r in bm25.op1_bm25_search(spark, str(tmp_path)).collect()} == {(q, q) for q in range(0, 400, 100)}
    (index,) = set(glob.glob(shared.folder(spark).removeprefix("file://") + "/bm25-index-*")) - before
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{index}/*.parquet")]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert len(files) == 1 and files[0].num_rows >= 40
    assert len(groups) >= 3 and max(g.total_byte_size for g in groups) < 5 << 20 and not any(g.column(c).is_stats_set for g in groups for c in range(g.num_columns))


def test_search_skips_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 50, 40 * 512), rng.integers(1000, 1050, 40 * 512)]).astype(np.uint64)
    shard = bm25.build_shard(np.arange(1024), words, np.arange(0, 40 * 1024 + 1, 40))
    shard = {k: np.asarray(shard[k]).astype(kind) for k, kind in bm25._KINDS.items()}
    searcher = bm25.Searcher(bm25.Queries(np.zeros(20, int), np.arange(20), np.ones(20), np.ones(20)), 5, 40.0, count=True)
    searcher.add(shard)
    assert searcher.skipped >= searcher.blocks // 2 and searcher.docs[0].max() < 512 and 0 < searcher.decoded <= searcher.postings
    # short queries of rare and common words: few postings are decoded, and a threshold from elsewhere spares more
    many = rng.zipf(1.3, 60 * 2048).astype(np.uint64) % np.uint64(5000)
    shard = bm25.build_shard(np.arange(2048), many, np.arange(0, 60 * 2048 + 1, 60))
    shard = {k: np.asarray(shard[k]).astype(kind) for k, kind in bm25._KINDS.items()}
    df = dict(zip(shard["terms"].tolist(), shard["counts"].tolist(), strict=True))
    query, term = np.repeat(np.arange(50), 4), np.concatenate([rng.choice(shard["terms"], 4, replace=False, p=shard["counts"] / shard["counts"].sum()) for _ in range(50)])
    idf = np.array([math.log(1 + (2048 - df[t] + 0.5) / (df[t] + 0.5)) for t in term.tolist()])
    shares, best = [], None
    for floors in (False, True):
        queries = bm25.Queries(query, term.view(np.int64), np.ones(200), idf)
        if floors:
            queries.floor = best.scores[:, -1].copy()
        searcher = bm25.Searcher(queries, 3, 60.0, count=True)
        searcher.add(shard)
        assert best is None or (np.array_equal(best.scores, searcher.scores) and np.array_equal(best.docs, searcher.docs))
        best = searcher
        shares.append(searcher.decoded / searcher.postings)
    print("share of postings decoded:", shares)
    assert shares[1] <= shares[0] < 0.5
    # where all terms together can't reach the threshold there is no pivot term, and no block is looked at
    queries.floor = np.full(50, 1e12)
    searcher = bm25.Searcher(queries, 3, 60.0, count=True)
    searcher.add(shard)
    assert searcher.skipped == searcher.blocks > 0 and searcher.decoded == 0 and not searcher.scores.any()


def test_search_with_thresholds_against_all_scores():
    """Random shards and queries of rare and common words: the k best are those of all documents, with thresholds from nothing, from others, and just at the k-th best."""
    import numpy as np

    rng = np.random.default_rng(9)
    for case in range(30):
        n_docs = int(rng.integers(1, 400))
        sizes = rng.integers(0, 30, n_docs)
        words = rng.zipf(1.2, int(sizes.sum())).astype(np.uint64) % np.uint64(300)
        at = np.concatenate([[0], np.cumsum(sizes)])
        shard = bm25.build_shard(np.arange(n_docs), words, at)
        shard = {k: np.asarray(shard[k]).astype(kind) for k, kind in bm25._KINDS.items()}
        if not len(shard["terms"]):
            continue
        query = np.repeat(np.arange(8), 5)
        term = np.concatenate([rng.choice(300, 5, replace=False) for _ in range(8)]).astype(np.int64)
        idf, times = rng.uniform(0.1, 6, 300), rng.integers(1, 4, 40).astype(float)
        mean, own = max(1.0, float(sizes.mean())), [dict(zip(*np.unique(words[a:b], return_counts=True))) for a, b in zip(at, at[1:])]
        share = lambda doc, t: bm25.shares(np.array([float(own[doc].get(t, 0))]), np.array([float(sizes[doc])]), np.array([idf[t]]), mean)[0] if t in own[doc] else 0
        score = np.array([[sum(c * share(d, np.uint64(t)) for t, c in zip(term[5 * q : 5 * q + 5], times[5 * q : 5 * q + 5])) for d in range(n_docs)] for q in range(8)])
        best = -np.sort(-score, axis=1)[:, :3] if n_docs >= 3 else None
        for floor in (np.zeros(8), best[:, 2] if best is not None else np.zeros(8)):
            queries = bm25.Queries(query, term, times, idf[term])
            queries.floor = floor.copy()
            searcher = bm25.Searcher(queries, 3, mean)
            searcher.add(shard)
            for q in range(8):
                want = sorted(((-s, d) for d, s in enumerate(score[q]) if s > 0))[:3]
                got = [(-s, d) for s, d in zip(searcher.scores[q].tolist(), searcher.docs[q].tolist()) if s > 0]
                assert got == want, (case, q)


def check_packing(rows, capacity, documents):
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    for doc, ids in documents.items():
        parts = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == capacity for r in parts[1:]) and (len(parts) == 1) == (len(ids) <= capacity)
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r["length"]]))
            at += r["length"]
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_bin)


def test_packing_documents(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9000, None), (9001, ""), (9002, "a <|endoftext|>  b<|endoftext|>")], "doc_id long, text string"))
    documents = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    bins = check_packing(rows, 1024, documents)
    query = packing.op8_best_fit_packing(spark, DATA).collect()
    assert check_packing(query, 1024, {k: v for k, v in documents.items() if k < 9000}) <= bins
    counts = collections.Counter(r["length"] for r in rows)
    assert packing.lower_bound(counts, 1024) <= bins <= sum(n for _, n in packing.best_fit(counts, 1024))
    small = packing.pack_documents(docs.limit(5), P.path("byte_bpe_50k.json"), capacity=16, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in small)
    assert packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_bin_completion_against_brute_force():
    def fewest(sizes, capacity):
        best = [len(sizes)]

        def go(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                    go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
            go(i + 1, [*rooms, capacity - sizes[i]])

        go(0, [])
        return best[0]

    rng = random.Random(9)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 11))), reverse=True)
        counts = collections.Counter(sizes)
        packing_ = packing.complete_bins(counts, 20)
        used = collections.Counter()
        for pattern, times in packing_:
            assert sum(a * b for a, b in pattern) <= 20
            for a, b in pattern:
                used[a] += b * times
        assert used == counts
        assert sum(n for _, n in packing_) == fewest(sizes, 20) >= packing.lower_bound(counts, 20)


def test_packing_does_not_depend_on_the_size():
    """Counts that are all many times as large need no more than so many times the bins (perfect packings of three pieces a bin, and one that can't be perfect)."""
    rng = random.Random(0)
    planted = []
    while len(planted) < 20:
        a, b = rng.randint(204, 512), rng.randint(204, 512)
        if 204 <= 1024 - a - b <= 512:
            planted += [(a, b, 1024 - a - b)]
    perfect = collections.Counter(k for three in planted for k in three)
    for counts, capacity, bins in ((perfect, 1024, 20), ({4: 5, 3: 5}, 10, 4)):
        for times in (1, 10, 1000, 100_000):
            many = {k: n * times for k, n in counts.items()}
            found = packing.complete_bins(many, capacity)
            used = collections.Counter()
            for pattern, n in found:
                assert n > 0 and sum(k * m for k, m in pattern) <= capacity
                for k, m in pattern:
                    used[k] += m * n
            assert used == many and sum(n for _, n in found) <= bins * times


def test_fractions_of_bins_bound_the_packing():
    """The bound of the fractional packing holds against brute force's results and can be above lower_bound(); the fractions hold the counts."""
    rng = random.Random(8)
    for _ in range(60):
        counts = dict(collections.Counter(rng.randint(1, 20) for _ in range(rng.randint(1, 9))))
        best = packing.complete_bins(counts, 20)
        shares, bound = packing.fractions(counts, 20, [p for p, _ in packing.best_fit(counts, 20)])
        assert bound <= sum(n for _, n in best) and bound - 1e-3 <= sum(x for _, x in shares) + 1
        for length, n in counts.items():
            assert sum(x * dict(p).get(length, 0) for p, x in shares) >= n - 1e-2
    shares, bound = packing.fractions({4: 4000, 3: 1000}, 10, [((4, 2),), ((3, 3),)])
    assert bound == 2250 > packing.lower_bound({4: 4000, 3: 1000}, 10) and abs(sum(x for _, x in shares) - 2250) < 1e-3


def test_planted_packings_are_found():
    rng = random.Random(4)
    for _ in range(60):
        sizes = []
        for _ in range(6):
            a, b = sorted(rng.sample(range(1, 60), 2))
            sizes += [a, b - a, 60 - b]
        counts = collections.Counter(sizes)
        packing_ = packing.complete_bins(counts, 60)
        used = collections.Counter()
        for pattern, times in packing_:
            assert sum(a * b for a, b in pattern) <= 60
            for a, b in pattern:
                used[a] += b * times
        assert used == counts and sum(n for _, n in packing_) == 6


def test_all_fillings():
    rng = random.Random(8)
    for _ in range(100):
        counts = collections.Counter(rng.randint(1, 12) for _ in range(rng.randint(1, 8)))
        lengths, room, slack = sorted(counts), rng.randint(1, 25), rng.randint(0, 25)
        ways = [dict(zip(lengths, ks, strict=True)) for ks in itertools.product(*(range(counts[k] + 1) for k in lengths))]
        want = set()
        for way in ways:
            waste = room - sum(k * n for k, n in way.items())
            better = any(way[x] < counts[x] and y < x <= y + waste for x in lengths for y in (0, *(k for k in lengths if way[k])))
            if 0 <= waste <= slack and not better:
                want.add(tuple((k, way[k]) for k in reversed(lengths) if way[k]))
        got = [p for _, p in packing.every_filling(room, lengths, counts, slack)]
        assert len(got) == len(set(got)) and set(got) == want


def test_urls(spark):
    rows = [
        (1, "http://a.net/x"), (2, "https://M.Example.NET/en/1#t"), (3, "http://example.com/de/"), (4, "http://x.org/fr/2?utm_source=a&b=1"), (5, "http://s.info/a/"),
        (6, "HTTP://WWW.S.info/a?utm_x=1#z"), (7, "s.info/a"), (8, None), (9, ""), (10, "http://net"), (11, "http://notnet/"), (12, "http://s.info/b"), (12, "http://s.info/b"),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    listed = spark.createDataFrame([("s.info/a",), ("s.info/a",), (None,)], "canonical_url string")
    got = {r["page_id"]: r for r in urls.url_verdicts(pages, listed).collect()}
    assert [got[i]["rule"] for i in (1, 2, 3, 4, 5)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None]
    assert [got[i]["verdict"] for i in range(1, 13)] == ["block", "allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert (got[2]["host"], got[2]["path"]) == ("m.example.net", "/en/1") and (got[10]["host"], got[10]["path"]) == ("net", "") and got[7]["host"] == got[8]["host"] == ""
    many = spark.range(5000).select(F.concat(F.lit("http://h.info/"), "id").alias("url"), F.col("id").alias("page_id"))
    half = many.filter("page_id % 2 = 0").select(urls.canonical(F.col("url")).alias("canonical_url"))
    assert {r["page_id"] for r in urls.url_verdicts(many, half).filter("verdict = 'block'").collect()} == set(range(0, 5000, 2))
    bloom = urls.build_filter(half, "canonical_url", 100)
    assert bloom.count() <= 100
    assert urls.url_verdicts(many.limit(0), half).count() == 0 and urls.url_verdicts(many, half.limit(0)).filter("verdict = 'block'").count() == 0


def test_listed_urls_behind_subdomains(spark, tmp_path):
    hosts = ["www.spam-farm.example.com", "m.spam-farm.example.com", "blog.spam-farm.example.com", "WWW.Spam-Farm.info", "not-spam-farm.info", "spam-farmer.info", "www.x.info"]
    rows = [(i, f"http://{h}/es/{i}") for i, h in enumerate(hosts)] + [(7, "http://x.info/spam-farm."), (8, None), (9, "https://spam-farm.example.com/es/0/?utm_source=a")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in urls.op6_url_filters(spark, str(tmp_path)).collect()}
    assert len(got) == 10 and {k for k, r in got.items() if r["listed"]} == {0, 1, 2, 3, 9}
    assert {k for k, r in got.items() if r["verdict"] == "block"} == {0, 1, 2, 3, 9}


def test_urls_with_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(urls, "SMALL_LIST", 10)
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 10)
    pages = spark.range(4000).select(F.concat(F.lit("http://h.info/"), F.col("id") % 1000).alias("u.r"), F.col("id").alias("page_id"), F.lit(1).alias("host"))
    pages = pages.union(spark.createDataFrame([(None, None, 1)], "url string, page_id long, host int"))
    listed = spark.range(0, 1000, 3).select(F.concat(F.lit("h.info/"), "id").alias("canonical_url"))
    got = urls.url_verdicts(pages, listed, url="u.r").collect()
    assert len(got) == 4001 and {r["page_id"] for r in got if r["listed"]} == {i for i in range(4000) if i % 1000 % 3 == 0}


def test_chat_swapped_answers(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "thanks"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "c"), (2, 0, "user", "x"),
        (3, 0, "user", "y"), (3, 1, "assistant", None), (4, 1, "assistant", "lone"), (None, 0, "user", "n"), (6, None, "user", "u"), (6, 1, "assistant", "d"), (7, 0, "assistant", "e"), (6, 1, "assistant", "d"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for r in chat.swapped_pairs(turns).collect():
        got[r["pair_id"]] = [tuple(t) for t in r["r"]]
        assert sorted(map(str, r["c"])) == sorted(str(x) for x in turns.filter(turns["conv_id"] == r["pair_id"]).select("turn", "role", "text").collect())
    key = lambda r: tuple((x is not None, x) for x in r)
    assert {k: sorted(v, key=key) for k, v in got.items()} == {
        0: [(0, "user", "q"), (1, "assistant", "c")], 1: [(0, "user", "q"), (1, "assistant", "a")], 2: [(0, "user", "x")], 3: [(0, "user", "y")],
        4: [], 6: [(None, "user", "u"), (1, "assistant", "e")], 7: [(0, "assistant", "d")],
    }
    assert chat.format_pairs(chat.swapped_pairs(turns.limit(0))).count() == 0
    nothing = turns.limit(0).withColumnRenamed("conv_id", "pair_id")
    assert chat.preference_pairs(nothing, nothing).count() == 0
    found = chat.op7_preference_format(spark, DATA).collect()
    assert sum(r["n_common"] > 0 for r in found) > 0.8 * len(found)


def test_chat(spark):
    schema = "pair_id long, turn long, role string, text string, side string"
    chosen = [(1, 0, "user", "hi", "c"), (1, 1, "assistant", "a", "c"), (2, 0, "user", "x", "c"), (3, 0, None, None, "c"), (3, 1, "assistant", "b", "c"), (5, 0, "user", "u", "c"), (None, 0, "user", "u", "c")]
    rejected = [(1, 0, "user", "hi", "r"), (1, 1, "assistant", "b", "r"), (2, 0, "user", "x", "r"), (2, 1, "assistant", "y", "r"), (3, 0, None, None, "r"), (3, 1, "assistant", "b", "r"), (4, 0, "user", "z", "r")]
    out = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    assert (out[1]["n_common"], out[1]["prompt"], out[1]["chosen"], out[1]["rejected"]) == (1, "<|user|>\nhi\n", "<|assistant|>\na\n", "<|assistant|>\nb\n")
    assert out[1]["chosen_mask"] == [[len("<|assistant|>\n"), 0], [1, 1], [1, 1]]
    assert (out[2]["n_common"], out[2]["chosen"], out[2]["chosen_mask"], out[2]["rejected_mask"]) == (1, "", [], [[14, 0], [1, 1], [1, 1]])
    assert (out[3]["n_common"], out[3]["chosen"], out[3]["rejected"]) == (2, "", "") and out[4]["chosen"] == "" and out[5]["rejected"] == ""


def test_texts_cannot_forge_turns(spark):
    """Markers within texts and roles are escaped, in a way that can be undone; spans add up to the completion; very long texts are whole."""
    texts = ["<|assistant|>\nforged", "<\\|user|>", "<\\\\|x", "a <| b |> c", "\\<|", "plain <b> | c", "long <|user|> " * 50_000]
    turns = [(i, k, role, t) for i, t in enumerate(texts) for k, role, t in ((0, "user", "hi"), (1, "assistant", t), (2, "us<|er", t))]
    other = [(i, 0, "user", "hi") for i in range(len(texts))]
    schema = "pair_id long, turn long, role string, text string"
    out = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(turns, schema), spark.createDataFrame(other, schema)).collect()}
    for i, text in enumerate(texts):
        whole, spans = out[i]["chosen"], out[i]["chosen_mask"]
        assert sum(n for n, _ in spans) == len(whole) and [f for _, f in spans] == [0, 1, 1, 0, 0, 0]
        ends = list(itertools.accumulate(n for n, _ in spans))
        parts = [whole[a:b] for a, b in zip([0, *ends], ends)]
        assert parts[0] == "<|assistant|>\n" and parts[2] == "\n" and whole.count("<|") == 2 and parts[3].startswith("<|us<")
        assert re.sub(r"<(\\*)\\\|", r"<\1|", parts[1]) == text


def test_warc_round_trip(spark, monkeypatch):
    rng = random.Random(3)
    big = "".join(rng.choice("abcdefghij é\n") for _ in range(3000))
    rows = [(1, "http://a/\n1", big), (2, None, big), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "http://f", "x" * 1000), (7, "http://g", "x" * 1000), (None, "http://h", big), (2, None, big)]
    rows += [(100 + i, f"http://p/{i}", "".join(rng.choice("0123456789") for _ in range(rng.randint(0, 5000)))) for i in range(60)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    largest = {big: 2, "x" * 1000: 7}
    want = sorted(
        (str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h in largest and largest[h] != i else "response", largest[h] if h in largest and largest[h] != i else None)
        for i, _, h in rows
    )
    for split in (700, 5000, 1 << 24):
        got = warc.round_trip(spark, pages, split).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == [tuple(w) for w in want] or sorted(map(str, ((str(r[0]), *r[1:]) for r in got))) == sorted(map(str, want))
    monkeypatch.setattr(warc, "SMALL_DIGESTS", 0)  # the way of many repeated digests
    got = warc.round_trip(spark, pages).collect()
    assert sorted(map(str, ((str(r[0]), *r[1:]) for r in got))) == sorted(map(str, want))
    manifest = warc.write_archives(warc.deduplicated(pages), shared.path(spark, "warc"), file_bytes=4000)
    assert manifest.count() > 3
    back = warc.read_archives(manifest, True, 999).filter("record_type = 'response'").collect()
    assert all(r["digest_agrees"] and hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in back)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_false_members_are_passed_over(tmp_path):
    from pyarrow import fs

    inner = zlib.compressobj(0, zlib.DEFLATED, 31)
    decoy = inner.compress(b"not a record") + inner.flush()
    members, offsets, at = [], [], 0
    for i in range(20):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the decoy's bytes show
        member = packer.compress(warc.record(i, "u", decoy + bytes([i]) * 50, "d", None)) + packer.flush()
        offsets.append(at)
        at += len(member)
        members.append(member)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    for step in (1, 37, 500, at):
        found = []
        for start in range(0, at, step):
            found += [o for o, _ in warc.records_in(fs.LocalFileSystem(), str(tmp_path / "a.warc.gz"), at, start, min(at, start + step))]
        assert found == offsets


def test_stages_keep_columns_as_they_are(spark):
    """Clashing and dotted names, nulls, repeated rows and empty tables pass through every filtering stage."""
    import corpus_pipeline

    base = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 400").limit(40)
    extra = {"score": "keepme", "kept": "me too", "n_words": "5", "nd_word": "w", "nd_maybe": "m", "nd_bits": "b", "c0": "zero", "a.b": "dot", "component_id": "c"}
    docs = base.withColumns({k: F.lit(v) for k, v in extra.items()})
    docs = docs.union(docs.limit(2)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        assert rows and all(tuple(r[len(base.columns) :]) == tuple(extra.values()) for r in rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    packed = corpus_pipeline.STAGES[3][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicates_with_colliding_words(spark):
    """Words on which hashes by powers modulo 2^64 collide link nothing."""
    one, two = ("".join("ab"[(bin(i).count("1") & 1) ^ flip] for i in range(1024)) for flip in (0, 1))
    tail = lambda w: " ".join([w] * 6)
    docs = spark.createDataFrame([(1, tail(one)), (2, tail(two)), (3, tail(one).upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = shared.written(stage(spark, now, DATA), "test-stage")
        if name != "best_fit_packing":
            assert after.columns == docs.columns
            kept.append({r["doc_id"] for r in after.select("doc_id").collect()})
        if name == "near_duplicates":
            before = [(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()]
            assert kept[-1] == {i for i, (_, c) in brute_components(before).items() if c == i}
        now = after
    assert kept[0] > kept[2] and kept[1] <= kept[0]
    assert {r["doc_id"] for r in now.select("doc_id").distinct().collect()} == kept[2]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, now.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    )
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), DATA).columns == docs.columns
