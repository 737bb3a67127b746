"""SentencePiece by backtracking, cross-tokenizer alignment and vector codes, against the libraries, brute force and SQL."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from latticework.llm import _text, alignment, pieces, vector_codes

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
DATA = "/root/testdata/sf0.001"
MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def encoded(texts):
    coder = pieces.encoder(MODEL)
    ids, at = coder.encode(*pieces.normalised(*_text.text_bytes(pa.array(texts, pa.string()))))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcdehinorst  \n.é▁日本ü0159ß😀\0", max_size=60) | st.text(max_size=20), min_size=1, max_size=5))
def test_pieces_as_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert encoded(texts) == library.encode(texts)


def test_pieces_of_spaces_and_syllables(library):
    rng = random.Random(5)
    parts = [" ", "  ", "    ", "th", "ing", "er", "and", "the", " the", "ly", "\t", "▁", "s", "tion"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += [" " * n for n in range(70)] + ["a" * n for n in range(1, 80)] + ["<s></s><unk><0x0A>", "\n", "▁", "▁▁a"]
    assert encoded(texts) == library.encode(texts)


def test_long_texts(library):
    for text in ("a" * 200_000, "the" * 50_000, " " * 30_001 + "x", "日本" * 20_000):
        assert encoded([text]) == [library.encode(text)]


def test_places_fail_and_pieces_are_taken_back():
    """A model in which the longest piece first is wrong: ab, bc (before ab) and abc's pieces."""
    model = pieces.encoder(MODEL).vocabulary
    small = object.__new__(pieces.PieceModel)
    names = ["a", "b", "c", "d", "bc", "ab", "cd", "bcd"]
    small.pieces, small.scores, small.kinds, small.size = names, [-9.0] * 4 + [-1.0, -2.0, -3.0, -4.0], [pieces.NORMAL] * 8, 8
    small.letter = model.letter
    names.append(pieces.SPACE)
    small.scores.append(-9.0)
    small.kinds.append(pieces.NORMAL)
    small.size = 9
    small._prepare()
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
        assert [small.text[i] for i in small.encode_slice(text)] == small.merged(text)
    assert [small.text[i] for i in small.encode_slice("abcab")] == ["a", "bc", "ab"]


def test_decoding_any_ids(library):
    rng, model = random.Random(7), pieces.encoder(MODEL).vocabulary
    for _ in range(500):
        ids = [rng.choice([rng.randrange(259, 32000), rng.randrange(3, 259), 29871, 0]) for _ in range(rng.randint(0, 8))]
        data, _ = pieces.decode(model, np.array(ids, np.int64), np.array([0, len(ids)]))
        assert data.tobytes().decode() == library.decode(ids)


def test_models_of_other_kinds_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1]))
    with pytest.raises(ValueError):
        pieces.PieceModel(str(path))


def test_op11_whole_query(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.op11_sentencepiece(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_eos=True)
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_op11_edges(spark, library):
    schema = "DOC_ID long, text string, ids string, n_tokens string"
    rows = [(1, None, "x", "y"), (1, None, "x", "y"), (None, "a  b", "x", None), (3, "", None, None), (4, "\n", None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in pieces.piece_digests(docs, MODEL).collect())
    assert got == collections.Counter((i, len(x), sha(" ".join(map(str, x)))) for i, t, *_ in rows for x in [library.encode(t or "", add_eos=True)])
    assert pieces.piece_digests(docs.limit(0), MODEL).count() == 0
    back = pieces.decode_documents(pieces.encode_documents(docs, MODEL), MODEL).collect()
    assert sorted(r["text"] for r in back) == sorted((t or "") for _, t, *_ in rows)


def brute_alignment(texts):
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    one.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    docs, count = [], collections.Counter()
    for t in texts:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        raw_a = [bytes(to_byte[c] for c in one.id_to_token(i)) for i in a]
        raw_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or {b"".join(raw_a), b"".join(raw_b)} != {(" " + t).encode()}:
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
        links = []
        for i in range(len(a)):
            for j in range(len(b)):
                if max(ends[0][i] - len(raw_a[i]), ends[1][j] - len(raw_b[j])) < min(ends[0][i], ends[1][j]):
                    links.append((a[i], b[j]))
        cuts, groups, last = sorted(set(ends[0]) & set(ends[1])), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, at) if last < e <= cut) for ids, at in ((a, ends[0]), (b, ends[1]))))
            last = cut
        count.update(links)
        docs.append((len(a), len(b), len(groups), links, sha(";".join(groups))))
    best = collections.Counter()
    for (_, y), c in count.items():
        best[y] = max(best[y], c)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs
    ]


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("share,block", [(1 << 20, 1 << 15), (40, 7)])
def test_alignment(spark, monkeypatch, share, block):
    """Also with lists of few postings, dealt out to many tasks, as those of frequent ids are."""
    monkeypatch.setattr(alignment, "SHARE", share)
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = random.Random(1)
    texts = ["", None, "▁x", "a b", "a b", "<|endoftext|> x", "日本 😀", "\n\n x", " ", " the" * 300, "the " * 40]
    texts += ["".join(rng.choice(["th", "ing ", " er", "and", "the", "\n", "é", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rows = [(None if i % 5 == 0 else i, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "DOC_ID int, text string, b int, `row` string").repartition(3)
    got = collections.Counter((r["doc_id"], *(r[c] for c in FIGURES)) for r in alignment.aligned(docs, BYTES, MODEL).collect())
    assert got == collections.Counter((r[0], *x) for r, x in zip(rows, brute_alignment(texts), strict=True))


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(docs, BYTES, MODEL).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r[c] for c in FIGURES) for r in alignment.aligned(only, BYTES, MODEL).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_op13_whole_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000")
    got = {r["doc_id"]: tuple(r[c] for c in FIGURES) for r in alignment.aligned(rows, BYTES, MODEL).collect()}
    rows = rows.collect()
    assert got == dict(zip([r["doc_id"] for r in rows], brute_alignment([r["text"] for r in rows]), strict=True))
    whole = alignment.op13_cross_tokenizer(spark, DATA)
    assert whole.count() == whole.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    # a pair's count is added once for each of its links, so the sums over documents are the sums of squared counts
    assert whole.agg({"n_links": "sum"}).first()[0] == whole.selectExpr("sum(n_a + n_b - n_groups)").first()[0]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 40), st.sampled_from([1, 2, 3, 4, 6, 8, 16, 32]), st.sampled_from([2, 40, 1 << 24]), st.integers(0, 1 << 30))
def test_nearest_entries(n, entries, size, spread, seed):
    rng = np.random.default_rng(seed)
    x, e = (rng.integers(-spread, spread + 1, (k, size)) for k in (n, entries))
    e[rng.integers(0, entries)] = x[0]
    far = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    near, least = vector_codes.Codebook(e).nearest(x)
    assert near.tolist() == far.argmin(axis=1).tolist() and least.tolist() == far.min(axis=1).tolist()


def test_bounds_filter():
    """Of 256 entries in groups, few get exact distances; bounds at every level stay below them."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (16, 1)) + rng.integers(-300, 300, (16, 16))
    e, x = (centres[rng.integers(0, 16, n)] + rng.integers(-30, 30, (n, 16)) for n in (256, 500))
    book = vector_codes.Codebook(e)
    far = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    before = 256
    for k, (sums, rest) in zip(book.levels, book.outlines):
        own = vector_codes.outlines(x, k)
        low = ((own[0][:, None] - sums[None]) ** 2).sum(axis=2) / (16 // k) + (own[1][:, None] - rest[None]) ** 2
        assert (low <= far * (1 + 1e-9) + 1e-3).all()
        left = (low <= far.min(axis=1)[:, None]).sum(axis=1).mean()
        assert left <= before
        before = left
    assert before < 40


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * c) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(order[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == n * parts]
    books = [[r[1][p * n : (p + 1) * n] for r in order if len(r[1]) == n * parts][:entries] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for r in kept:
                held[nearest(p, r[1][p * n : (p + 1) * n])[1]].append(r[1][p * n : (p + 1) * n])
            for k, xs in held.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = sha(",".join(str(c) for book in books for e in book for c in e))
    found = [(r, [nearest(p, r[1][p * n : (p + 1) * n]) for p in range(parts)]) for r in kept]
    total = collections.Counter()
    for r, x in found:
        total[r[2]] += sum(d for d, _ in x)
    return collections.Counter((r[0], "".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x), total[r[2]], digest) for r, x in found)


@pytest.mark.parametrize("few", [10_000, 1])
def test_codes(spark, monkeypatch, few):
    """Ties, repeated rows and ids, nulls and other lengths; with few labels (sent to all tasks) and many (salted)."""
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    rng = random.Random(4)
    rows = [(i % 90 if i % 7 else None, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += rows[:40] + [(1, None, 1), (2, [0.0] * 15 + [None], 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] + [0.0] * 15, None), (5, [1.0] * 8, 2), (6, [], 2)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "VEC_ID int, embedding array<double>, label int, code string, x int").repartition(3)
    got = collections.Counter(tuple(r) for r in vector_codes.compressed(table).collect())
    assert got == brute_codes(rows)


def test_codes_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compressed(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    rows = [(7, [0.1, 0.2, 0.3, -0.4], "a"), (8, [0.1, 0.2, 0.3, 0.5], None), (9, [9.0, 0.0, 0.0, 0.0], None)]
    single = [(i, [float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    assert collections.Counter(tuple(r) for r in vector_codes.compressed(spark.createDataFrame(rows, schema)).collect()) == brute_codes(single)
    for wrong in ([1.0] * 6, [1e30] * 4):
        with pytest.raises(ValueError):
            vector_codes.compressed(spark.createDataFrame([(1, wrong, "a")], schema))


def test_op12_as_sql(spark):
    at = "/root/testdata/sf0.1"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
        want = sorted(con.execute(vector_codes.OP12_SQL).fetchall())
    assert sorted(tuple(r) for r in vector_codes.op12_vector_codes(spark, at).collect()) == want
