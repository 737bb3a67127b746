"""Repetition, BPE, licences and language mixtures against brute force."""

import collections
import hashlib
import random
import re

import base64
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from latticework.llm import _text, bpe, langid, licences, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def chunk(texts):
    return _text.text_bytes(pa.array(texts, pa.string()))


def brute_rules(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    out = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))]
    for n in (8, 5):
        seen = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        out.append(len({j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}))
    longest = 0
    for i in range(len(words)):
        for j in range(i):
            k = 0
            while i + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    return [*out, longest]


def thue_morse(n, flip):
    """Words of a and b on which hashes by powers modulo 2^64 collide, for flip 0 and 1."""
    return "".join("ab"[(bin(i).count("1") & 1) ^ flip] for i in range(n))


def test_distinct_runs_by_bytes(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 127, 128, 129, 300]))) for _ in range(500)]
    words += [thue_morse(1024, 0), thue_morse(1024, 1), *words[:50]]
    data, offs = chunk([" ".join(words)])
    starts, ends, _ = _text.words(data, offs)
    assert len(starts) == len(words)
    for hashes in (_text.hashes, lambda d, s, e: (e - s).astype(np.uint64), lambda d, s, e: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(_text, "hashes", hashes)
        first, which = _text.distinct(data, starts, ends)
        assert [words[first[k]] for k in which] == words and len(first) == len(set(words))
    monkeypatch.undo()
    h = _text.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))


def test_words_that_collide_modulo_powers_of_two(spark):
    one, two = thue_morse(1024, 0), thue_morse(1024, 1)
    got = repetition.measure(*chunk([" ".join([one, two] * 8), " ".join([one] * 16)]), 5)
    assert [brute_rules(" ".join(x)) for x in ([one, two] * 8, [one] * 16)] == [
        [int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")] for i in (0, 1)
    ]
    apart = repetition.measure(*chunk([" ".join([one, *"cdefghi", two, *"cdefghi"])]), 5)
    assert apart["n_repeat_words"][0] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é ", max_size=60), min_size=1, max_size=6))
def test_repetition(texts):
    got = repetition.measure(*chunk(texts), 5)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    assert [[int(got[k][i]) for k in names] for i in range(len(texts))] == [brute_rules(t) for t in texts]


def test_repetition_query_and_edges(spark):
    loop, plain = "one two three four five six seven eight " * 30, " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, plain, 7), (4, loop, 8), (3, plain, 7)], "doc_id long, text string, kept int")
    out = repetition.repetition_rules(docs)
    assert out.columns.count("kept") == 1
    found = sorted((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in out.collect())
    assert found == [(1, 0, True, False), (2, 0, True, False), (3, 100, False, True), (3, 100, False, True), (4, 240, True, False)]
    assert repetition.repetition_rules(docs.limit(0)).count() == 0
    spans = repetition.text_repeats("a b c d e f x a b c d e f y", 5)
    assert spans == [(0, 6), (7, 6)]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    assert P.PATTERN == bpe.PATTERN
    there = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return P, there, other


def test_bpe_same_as_libraries(spark, tokenizers):
    P, there, other = tokenizers
    rng = random.Random(5)
    parts = ["'s", "'re", "'", "t", "ll", " ", "  ", "\n", "\t", "ab", "12", "!?", "é", "中文", " ", "　", "😀", "\r\n", "<|endoftext|>", "'LL", "x" * 90, "x" * 300, "\u00e9" * 200]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "\n\n", thue_morse(1024, 0), thue_morse(1024, 1), "<|endoftext|>", "  <|endoftext|>  a"]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    for name, library in (("byte_bpe_50k.tiktoken", there.encode_ordinary), ("byte_bpe_50k.json", lambda t: other.encode(t, add_special_tokens=False).ids)):
        coder = bpe.encoder(P.path(name))
        ids, at = coder.encode(*chunk(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library(t), t
    sweep = ["a" + chr(i) + "1" + chr(i) for i in range(0x80, 0x30000, 7) if not 0xD800 <= i < 0xE000]
    coder = bpe.encoder(P.path("byte_bpe_50k.tiktoken"))
    ids, at = coder.encode(*chunk(sweep))
    assert all(ids[at[i] : at[i + 1]].tolist() == there.encode_ordinary(t) for i, t in enumerate(sweep))


def test_bpe_long_texts(tokenizers):
    P, there, other = tokenizers
    rng = random.Random(6)
    texts = ["".join(rng.choice("ACGT") for _ in range(300_000)), "a" * 70_000, " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(400_000)), "b"]
    assert len(texts[2]) > 2 * _text.CHUNK_BYTES
    for name, library in (("byte_bpe_50k.tiktoken", there.encode_ordinary), ("byte_bpe_50k.json", lambda t: other.encode(t, add_special_tokens=False).ids)):
        ids, at = bpe.encoder(P.path(name)).encode(*chunk(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library(t) for t in texts]


def test_bpe_round_trip_and_digests(spark, tokenizers):
    P, there, _ = tokenizers
    path = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "Hello  wörld's\n 12"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    encoded = bpe.encode_documents(docs, path)
    row = encoded.filter("doc_id = 1").first()
    assert row["ids"] == there.encode_ordinary("Hello  wörld's\n 12") and row["ends"][-1] == len("Hello  wörld's\n 12".encode())
    assert sorted(r["text"] for r in bpe.decode_documents(encoded, path).collect()) == ["", "", "", "Hello  wörld's\n 12"]
    for r in bpe.token_digests(docs, path).collect():
        text = "Hello  wörld's\n 12" if r["doc_id"] == 1 else ""
        ids = there.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.token_digests(docs.limit(0), path).count() == 0


def test_licences(spark):
    body = licences.TEMPLATES["MIT"]
    rows = [(1, "x y\nReleased under the MIT License!\nz"), (2, "Copyright 2020 A\n\n" + body), (3, None), (4, ""), (5, "no licence at all here"), (6, body.replace("\n\n", "\n"))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licences int")
    found = {r["doc_id"]: {m["template"]: m for m in r["licences"]} for r in licences.licence_scan(docs).collect()}
    assert set(found[1]) == {"MIT notice"} and found[1]["MIT notice"]["dice"] == 1.0
    assert rows[0][1].encode()[found[1]["MIT notice"]["start"] : found[1]["MIT notice"]["end"]].decode() == "Released under the MIT License"
    assert "MIT" in found[2] and found[2]["MIT"]["dice"] > 0.95 and "MIT" in found[6]
    assert not found[3] and not found[4] and not found[5]


def test_licences_in_long_texts(spark):
    words = np.random.default_rng(5).permutation([f"w{i}" for i in range(3000)]).tolist()
    before, after = " ".join(words[:1500]), " ".join(words[1500:])
    rows = [(name, f"{before}\n\n{body}\n\n{after}") for name, body in licences.TEMPLATES.items()]
    rows += [(name + " in a line", " ".join(f"{before} {body} {after}".split())) for name, body in licences.TEMPLATES.items()]
    rows += [("none", before + after), ("shared line", "Copyright 2020 Foo. Released under the MIT License.")]
    rows += [("twice", f"{licences.TEMPLATES['ISC']}\n\n{before}\n\n{licences.TEMPLATES['MIT']}\n\n{after}")]
    found = {r["name"]: {m["template"]: m for m in r["licences"]} for r in licences.licence_scan(spark.createDataFrame(rows, "name string, text string")).collect()}
    texts = dict(rows)
    for name, body in licences.TEMPLATES.items():
        for key in (name, name + " in a line"):
            match = found[key][name]
            assert match["dice"] == 1.0
            there = texts[key].encode()[match["start"] : match["end"]].decode()
            assert " ".join(there.split()) in " ".join(body.split()) and len(there) > 0.9 * len(body)
    assert not found["none"] and set(found["shared line"]) == {"MIT notice"} and {"ISC", "MIT"} <= set(found["twice"])


def test_all_templates(spark):
    every = licences.every_template()
    assert len(every) == 38 and set(licences.TEMPLATES) < set(every)
    rows = [(name, f"x y z\n\n{body}\n\nu v w") for name, body in every.items()] + [("planted", "Some words of a text.\nAll rights reserved."), ("none", "all of these rights are reserved")]
    found = {r["name"]: {m["template"]: m["dice"] for m in r["licences"]} for r in licences.licence_scan(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert all(found[name][name] > 0.94 for name in every)
    assert found["planted"] == {"Proprietary notice": 1.0} and not found["none"]


def test_language_sets_are_ended_by_the_penalty_alone(spark):
    rng = np.random.default_rng(7)
    letters = {"a": "abcde", "b": "fghij", "c": "klmno", "d": "pqrst", "e": "uvwxy", "f": "zäöüß"}

    def text(lang, words):
        return " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(words))

    model = langid.learn(spark.createDataFrame([(text(x, 3000), x) for x in letters], "text string, lang string"))
    texts = [" ".join(text(x, 200) for x in "abcde"), text("a", 20000) + " " + text("b", 300), text("c", 500)]
    data = "".join(texts).encode()
    weights = langid.mixtures(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(x.encode()) for x in texts)]), model).shares
    sets = [{x for x, w in zip(model.languages, row, strict=True) if w > 0} for row in weights.tolist()]
    assert sets == [set("abcde"), set("ab"), set("c")]
    assert abs(weights[0][:5] - 0.2).max() < 0.02 and 0.005 < weights[1][1] < 0.02


def test_licence_windows():
    rng = np.random.default_rng(6)
    hits = 0
    for _ in range(400):
        own = np.unique(rng.integers(0, 12, rng.integers(1, 9))).astype(np.uint64)
        text = rng.integers(0, rng.integers(6, 30), rng.integers(2, 60)).astype(np.uint64)
        least = float(rng.choice([0.5, 0.6, 0.75, 0.9]))
        sets = {(i, j): set(text[i : j + 1].tolist()) for i in range(len(text)) for j in range(i, len(text))}
        want = max(2 * len(x & set(own.tolist())) / (len(x) + len(own)) for x in sets.values())
        got = licences.window(text, own, least)
        assert (got is None) == (want < least)
        if got:
            inside = sets[got[1:]]
            assert got[0] == want == 2 * len(inside & set(own.tolist())) / (len(inside) + len(own))
            hits += 1
    assert hits > 50


def test_language_mixtures(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs.filter(~langid.held_out()))
    judged = langid.identify(docs.withColumn("score", docs["doc_id"]), model).withColumn("held", langid.held_out()).collect()
    held = [r for r in judged if r["held"] and r["lang_pred"] != "und"]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and abs(sum(r["shares"]) - 1) < 1e-6 for r in held)
    texts = {x: max((r["text"] for r in judged if r["lang"] == x and r["text"]), key=len)[:3000] for x in ("en", "de")}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ... !"), (4, texts["en"] + "\n" + texts["de"]), (5, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0.0
    assert set(got[4]["langs"]) == {"en", "de"} and got[5]["lang_pred"] in model.languages
    empty = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}
    like, at = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0])
    weights, _, _ = langid._fit(like, np.array([3.0, 1.0]), at, np.array([[0.5, 0.5]]))
    best = max(np.linspace(0.001, 0.999, 999), key=lambda p: 3 * np.log(0.9 * p + 0.1 * (1 - p)) + np.log(0.1 * p + 0.9 * (1 - p)))
    assert abs(weights[0, 0] - best) < 0.01


def test_language_sets_against_all_subsets():
    """Every subset of languages, each fitted for long: the chosen set's penalised likelihood is the best of all, and the score follows from it."""
    rng = np.random.default_rng(11)
    names, buckets = list("abcd"), 40
    likelihoods = np.zeros((langid.BUCKETS, 4))
    base = rng.dirichlet(np.ones(buckets))
    for k in range(4):
        likelihoods[:buckets, k] = 0.5 * base + 0.5 * rng.dirichlet(np.full(buckets, 0.3))
    likelihoods = np.maximum(likelihoods, 1e-9)
    sizes = set()
    for case in range(30):
        shares = rng.dirichlet(np.full(4, 0.4))
        drawn = rng.choice(buckets, int(rng.integers(5, 1500)), p=(likelihoods[:buckets] @ shares) / (likelihoods[:buckets] @ shares).sum())
        got = mixture_of(drawn, langid.Model(names, likelihoods))
        count = np.bincount(drawn, minlength=buckets).astype(float)
        n, best = len(drawn), {}
        for mask in range(1, 16):
            own = [k for k in range(4) if mask >> k & 1]
            weights = np.full(len(own), 1 / len(own))
            for _ in range(1000):
                weights = weights * ((likelihoods[:buckets, own] / (likelihoods[:buckets, own] @ weights)[:, None]) * count[:, None]).sum(axis=0) / n
            best[mask] = (count * np.log(likelihoods[:buckets, own] @ weights)).sum() - len(own) * langid.PENALTY * np.log(n + 1), own, weights
        top = max(v[0] for v in best.values())
        chosen = sum(1 << k for k in range(4) if got.shares[0][k] > 0)
        assert best[chosen][0] >= top - 0.3, case
        assert np.abs(got.shares[0][best[chosen][1]] - best[chosen][2]).max() < 0.05
        lead = int(np.argmax(got.shares[0]))
        other = max(best[1 << k][0] for k in range(4) if k != lead)
        assert abs(got.confidence[0] - 1 / (1 + np.exp(-max(0, best[chosen][0] - other) / n * min(n, langid.EVIDENCE)))) < 0.02
        sizes.add(bin(chosen).count("1"))
    assert sizes >= {1, 2, 3}


def test_proportions_converge_where_likelihoods_are_flat():
    """Languages that hardly differ, long texts: every fit ends within GAP of the best, without a limit of rounds."""
    rng = np.random.default_rng(5)
    base = rng.dirichlet(np.ones(60))
    for spread in (0.3, 0.02):
        like = np.stack([(1 - spread) * base + spread * rng.dirichlet(np.full(60, 0.3)) for _ in range(5)], axis=1)
        count = np.stack([rng.multinomial(n, like @ rng.dirichlet(np.full(5, 0.3))) for n in (30, 3000, 40_000)]).astype(float) + 1e-9
        weights, value, gap = langid._fit(np.tile(like, (3, 1)), count.ravel(), np.array([0, 60, 120]), np.full((3, 5), 0.2))
        assert (gap <= langid.GAP).all() and np.allclose(weights.sum(axis=1), 1)
        for k in range(3):
            w = np.full(5, 0.2)
            for _ in range(20_000):
                w = w * ((like / (like @ w)[:, None]) * count[k][:, None]).sum(axis=0) / count[k].sum()
            assert value[k] >= (count[k] * np.log(like @ w)).sum() - langid.GAP


def mixture_of(drawn, model):
    """langid.mixtures of one text with the given buckets."""
    real = langid.trigrams
    langid.trigrams = lambda data, offs: (drawn, np.zeros(len(drawn), np.int64), np.ones(1, bool))
    try:
        return langid.mixtures(np.zeros(1, np.uint8), np.array([0, 1]), model)
    finally:
        langid.trigrams = real


def test_low_thresholds_are_refused():
    for wrong in (0.3, 0.5, 1.1):
        with pytest.raises(ValueError):
            licences.Templates({"a": "one two three"}, wrong)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "hello there my friend", "en", 5, "x"), (None, "guten tag mein freund", "de", 6, "y"), (3, None, None, None, None), (3, "", "en", 1, "z")], "doc_id long, text string, lang string, score int, `a.b` string")
    with pytest.raises(ValueError, match="more than 1"):
        langid.learn(docs, most=1)
    model = langid.learn(docs)
    assert model.languages == ["de", "en"]
    out = langid.identify(docs, model)
    assert out.columns[:4] == ["doc_id", "text", "lang", "a.b"] and out.count() == 4 and langid.identify(docs.limit(0), model).count() == 0
    kept = langid.one_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r["text"], r["score"], r["a.b"]) for r in kept.collect()) == [("guten tag mein freund", 6, "y"), ("hello there my friend", 5, "x")]
    assert langid.one_language(spark, docs.limit(0), "").columns == docs.columns


def brute_verdict(text):
    words = WORD.findall(text)
    low, high = 0, len(words)
    while low < high:  # the longest run of words found twice: if one of n words is, so is one of n - 1
        n = (low + high + 1) // 2
        runs = [hashlib.sha256(" ".join(words[i : i + n]).encode()).digest() for i in range(len(words) - n + 1)]
        low, high = (n, high) if len(set(runs)) < len(runs) else (low, n - 1)
    longest, out = low, []
    for n in (8, 5):
        seen = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        out.append(len({j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * out[0] > 30 * len(words)
    figures = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), out[0])
    return (*figures, failed, not failed and 10 * out[1] <= 3 * len(words) and longest <= 60)


def test_rules_query_against_brute_force(spark):
    got = {r["doc_id"]: r for r in repetition.op4_repetition_rules(spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert {i: tuple(r[k] for k in names) for i, r in got.items()} == {i: brute_verdict(t) for i, t in texts.items()}
    assert {r["kept"] for r in got.values()} == {True, False}


def test_rules_at_their_limits(spark):
    own = iter(f"w{i}" for i in range(100_000))
    take = lambda n: [next(own) for _ in range(n)]

    def spans(total, size, times=2):
        """A text of ``total`` words of which a run of ``size`` words stands ``times`` times."""
        run = take(size)
        parts, left = [run] * times, total - size * times
        out = []
        for part in parts:
            out += take(left // (times + 1)) + part
        return out + take(total - len(out))

    cases = {
        1: (take(19), False), 2: (take(20), True),
        3: (spans(100, 5, 6), True), 4: (spans(100, 5, 6)[:-1], False),  # 30 of 100, 30 of 99 words covered by runs of five
        5: (spans(1000, 60), True), 6: (spans(1000, 61), False), 7: (spans(1000, 4, 100), True),
    }
    docs = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in cases.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in repetition.repetition_rules(docs).collect()}
    assert got == {i: k for i, (_, k) in cases.items()} == {i: brute_verdict(" ".join(w))[-1] for i, (w, _) in cases.items()}


def test_rules_of_long_texts():
    """Texts over several chunks, one of them longer than a chunk."""
    rng = random.Random(2)
    texts = [" ".join(f"{rng.randrange(300)}" for _ in range(n)) for n in (300_000, 10, 200_000, 0)]
    texts[0] = texts[0] + " " + texts[0][:3999].rpartition(" ")[0]
    assert len(texts[0]) > _text.CHUNK_BYTES
    data, offs = chunk(texts)
    parts = [repetition.measure(d, o, 5) for _, _, d, o in _text.chunks(data, offs)]
    assert len(parts) >= 2
    got = np.concatenate([p["n_words"] for p in parts]).tolist(), np.concatenate([p["n_repeat_words"] for p in parts]).tolist()
    want = []
    for words in map(str.split, texts):
        seen = collections.Counter(zip(*(words[k:] for k in range(8))))
        want.append(len({j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}))
    assert got[0][1:] == [10, 200_000, 0] and got[1] == want and want[0] > 1000


def test_bpe_query_against_the_library(spark, tokenizers):
    _, there, _ = tokenizers
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = bpe.op2_byte_bpe(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = there.encode_ordinary(texts[r["doc_id"]])
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_language_query(spark):
    import zlib

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = langid.op10_language_id(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")) for r in rows)
    told = [(r["lang_pred"], docs[r["doc_id"]]["lang"]) for r in rows if r["held_out"] and r["lang_pred"] != "und" and docs[r["doc_id"]]["lang"]]
    assert len(told) > 30 and sum(a == b for a, b in told) / len(told) > 0.95
    assert len({r["score"] for r in rows}) > len(rows) / 2


def test_licences_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licences.licence_scan(docs).columns == ["doc_id", "text", "licences"] and licences.licence_scan(docs).count() == 0
