"""Each operator against brute force, and on nulls, empty texts, repeats and odd columns."""

import collections
import hashlib
import itertools
import math
import re
import tracemalloc
import zlib
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tannin.llm import (
    bpe, components, mixing, nearest, pitman_yor, quality, simhash, token_counts, token_store,
    toxicity, url_filter, words,
)
from tannin.llm.word_ids import word_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(words.UPPER, words.LOWER)
PATH = public_tokenizers.path("word_bpe_49k.json")
#: Columns whose names operators use inside, with other meanings.
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, _row string, fingerprint string, mix int"
PROSE = "It was the best of times, it was the worst of times. " * 3


def rows_of():
    long = " ".join(f"word{i % 977} Über{i % 31}." for i in range(4000))
    texts = [
        None, "", " \n\t ", "one", "A a\x0bA\ta", PROSE, PROSE, PROSE.upper(), PROSE + "now",
        long, "<|endoftext|> x<|startoftext|>y", "naïve ΣΑΣ İstanbul 3.14 don't 日本語 a\u3000b", "\u00a0",
        "line\nline\n\nother\nline", "$$$ ### a|b <c>", "x" * 5000,
    ]
    rows = [(i, t, ("en", None, "de")[i % 3], ("a", None, "b", "a")[i % 4], 7, "r", "f", 1)
            for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "lost and found", None, None, None, None, None, None), (None, None) + (None,) * 6]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


# --- words and tokens -------------------------------------------------------

def test_forgotten_words_are_encoded_alike():
    coder = word_ids(PATH)
    small = type(coder)(coder.tokenizer, max_words=40)
    random = np.random.default_rng(4)
    for _ in range(60):
        words_ = sorted({f"{'sea' * int(i % 3)}tide{i}." for i in random.zipf(1.3, 12) % 5000} | {"the"})
        ids, counts = small.gather(small.slots_of(pa.array(words_)))
        assert len(small.slots) == len(small.asked) <= 40
        expected = [coder.tokenizer.encode(w, add_special_tokens=False).ids for w in words_]
        assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]


@given(st.lists(st.one_of(st.none(), st.text(" \t\n\x0b\x0c\rab\x1cé\u00a0", max_size=12)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_split_words(texts):
    found = words.split_words(pa.array(texts, pa.string()))
    held = found.words.to_pylist()
    assert [held[a:b] for a, b in zip(found.offsets, found.offsets[1:])] == [WORD.findall(t or "") for t in texts]


TEXT = st.text(st.one_of(st.sampled_from("abAB .,!?'\n\t<|>\u0301\u00e9ΣİÅ"), st.characters(exclude_categories=["Cs"])),
               max_size=30)


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_words_and_merges_encode_like_the_library(text):
    tokenizer = Tokenizer.from_file(PATH) if not hasattr(test_words_and_merges_encode_like_the_library, "t") \
        else test_words_and_merges_encode_like_the_library.t
    test_words_and_merges_encode_like_the_library.t = tokenizer
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    distinct, index = words.split_words(pa.array([text])).distinct()
    coder = word_ids(PATH)
    assert coder.gather(coder.slots_of(distinct)[index])[0].tolist() == expected
    own = bpe._bpe(PATH)
    ids, counts = own.encode(distinct.to_pylist())
    ends = np.cumsum([0, *counts])
    assert [i for k in index for i in ids[ends[k]:ends[k + 1]].tolist()] == expected
    assert own.decode(pa.array([expected], pa.list_(pa.int32()))).to_pylist() == [
        tokenizer.decode(expected, skip_special_tokens=False)]


@given(st.lists(st.sampled_from("abc"), max_size=14))
def test_merges_take_the_lowest_rank_first(letters):
    merges = [("a", "a"), ("aa", "b"), ("b", "c"), ("aab", "a"), ("aa", "a")]
    names = ["a", "b", "c", *(x + y for x, y in merges)]
    vocabulary = {n: i for i, n in enumerate(dict.fromkeys(names))}
    own = bpe.Merges(vocabulary, merges)
    ids, _ = own.apply(np.array([vocabulary[c] for c in letters], np.int64), np.array([0, len(letters)]))
    word = list(letters)
    while True:
        pairs = [(merges.index(p), i) for i, p in enumerate(zip(word, word[1:])) if p in merges]
        if not pairs:
            break
        _, i = min(pairs)
        word[i:i + 2] = [word[i] + word[i + 1]]
    assert ids.tolist() == [vocabulary[w] for w in word]


def test_counts_and_encodings(docs, none):
    tokenizer = Tokenizer.from_file(PATH)
    expected = {}
    for row in rows_of():
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids
        expected[(row[0], row[1])] = ids
    counted = token_counts.token_counts(docs, PATH, batch_bytes=100, limit=100)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counted.collect()) == sorted(
        (row[0] or -1, len((row[1] or "").encode()), len(expected[row[:2]]), len(expected[row[:2]]) > 100)
        for row in rows_of())
    encoded = bpe.encode(docs, PATH, decoded=True)
    assert sorted((r["doc_id"] or -1, list(r["ids"]), r["decoded"]) for r in encoded.collect()) == sorted(
        (row[0] or -1, expected[row[:2]], tokenizer.decode(expected[row[:2]], skip_special_tokens=False))
        for row in rows_of())
    again = bpe.decode(encoded.withColumnRenamed("decoded", "first"), PATH)
    assert again.filter("first != decoded").count() == 0
    assert token_counts.token_counts(none, PATH).count() == bpe.encode(none, PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    texts = [" ".join(f"word{i} and" for i in range(30_000)), "a  b\n c", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r["n_tokens"] for r in by_id(token_counts.token_counts(docs, path))]
    if name.endswith("json"):
        expected = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece
        expected = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in texts]
    assert found == expected


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60), min_size=128, max_size=512), st.floats(0.01, 1))
@settings(max_examples=50, deadline=None)
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids[:len(ids) // 128 * 128], np.uint32)
    data, base, width, size = token_store.encode_blocks(ids, percentile)
    assert np.array_equal(token_store.decode_blocks(data, np.cumsum(size) - size, base, width, size), ids)


def test_store_round_trip(docs, none, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    files = token_store.write_store(docs, PATH, folder=str(tmp_path))
    found = token_store.read_store(files).collect()
    assert len(found) == len(rows_of())
    lists = collections.Counter((r["doc_id"], bytes(r["ids"])) for r in found)
    assert lists == collections.Counter(
        (row[0], np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
        for row in rows_of())
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    # any range by the block starts
    path = files.orderBy(F.desc("n_ids")).first()["file"]
    with open(path, "rb") as file:
        store = token_store.StoreReader(pa.PythonFile(file))
        whole = store.ids(0, int(pa.compute.sum(store.docs.column("n_tokens")).as_py()))
        assert np.array_equal(store.ids(130, 401), whole[130:401])
    assert token_store.read_store(token_store.write_store(none, PATH)).count() == 0


# --- URLs -------------------------------------------------------------------

def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("example.org", "/en/1", "allow"), (None, "/", "block"), ("com", "", "block")]
    urls = [None, "", "no scheme", "http://a.example.org/es/x?y=/en/", "http://EXAMPLE.ORG/en/12#a", "x://myexample.org/es/",
            "http://org/", "http://org", "http://a.com?x", "http://net/", "http://b.com/long/path", "://"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, path string")
    listed = url_filter.write_list(spark.createDataFrame(rules, "host string, path string, verdict string"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
             for r in url_filter.judge_urls(pages, listed).collect()}
    assert [found[i] for i in range(len(urls))] == [
        ("", "", None, "allow")] * 3 + [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("myexample.org", "/es/", "org/", "allow"), ("org", "/", "org/", "allow"), ("org", "", None, "allow"),
        ("a.com", "", "com", "block"), ("net", "/", None, "allow"), ("b.com", "/long/path", "com", "block"),
        ("", "", None, "allow")]
    nothing = url_filter.write_list(spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in url_filter.judge_urls(pages, nothing, "block").collect()} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0


def test_equal_digests_are_told_apart(tmp_path):
    texts = [b"a/", b"b/"]
    path = tmp_path / "x.urls"
    path.write_bytes(np.array([2, 0], "<u8").tobytes() + np.array([5, 5], "<u8").tobytes()
                     + np.array([0, 2, 4], "<u8").tobytes() + bytes([0, 1]) + b"".join(texts))
    array = url_filter.DigestArray(str(path))
    assert array.find(np.array([5, 5, 5], np.uint64), [b"b/", b"a/", b"c/"]).tolist() == [1, 0, -1]


# --- language model ---------------------------------------------------------

def test_pitman_yor_sums_and_counts(spark, docs, none):
    extra = [(100 + i, f"the cat sat on the {w} mat", "en", "a", 0, "", "", 0)
             for i, w in enumerate(["red", "blue", "old", "new"] * 10)]
    table = docs.union(spark.createDataFrame(extra, SCHEMA))
    rows = rows_of() + extra
    found = pitman_yor.score_texts(table, contexts=3, parts=3).collect()
    assert len(found) == len(rows)
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = collections.Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((r[0] or -1, held(r[0]), len(t := tokens(r[1])), sum(counts[w] > 0 for w in t), n,
                       round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r in rows)
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in found) == expected
    some = [r for r in found if r["doc_id"] and r["doc_id"] >= 100]
    assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(table, contexts=3, parts=3).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in found if r["doc_id"] not in (None, 5))
    assert pitman_yor.score_texts(none).count() == 0


def test_scores_do_not_depend_on_the_partitions(spark):
    random = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in random.zipf(1.4, 60) % 90)) for i in range(200)]
    rows += [(300, "again " * 700), (301, "again " * 700)]
    found = []
    for partitions in (1, 7):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        found.append({r["doc_id"]: r["score"] for r in pitman_yor.score_texts(table, contexts=5, parts=3).collect()})
    assert found[0] == pytest.approx(found[1], rel=1e-12)


def test_packing_holds_few_bytes_per_token(monkeypatch):
    """A block's arrays, without the texts and Arrow's own memory."""
    class Docs:
        schema = T.StructType([T.StructField("doc_id", T.LongType())])
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(pitman_yor, "TaskContext", mock.MagicMock(get=lambda: mock.MagicMock(partitionId=lambda: 3)))
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in random.zipf(1.3, 1000) % 3000) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(300), "text": texts, "train": [i % 5 > 0 for i in range(300)]})
    run = pitman_yor._pack(Docs(), [f"w{k}" for k in range(1, 500)], 6)
    tracemalloc.start()
    packed = sum(len(r["place"]) // 2 for out in run(iter([batch])) for r in out.to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    chains = [["", *t.split(), "\n"] for t in texts]
    assert packed == len({(i, *pair) for i, chain in enumerate(chains) for pair in zip(chain, chain[1:])})
    assert peak < 55 * sum(len(chain) - 1 for chain in chains)


def held_out_ids(n):
    return [i for i in range(100, 100 + 10 * n) if zlib.crc32(str(i).encode()) % 5 == 1][:n]


def trained_ids(n):
    return [i for i in range(100, 100 + 10 * n) if zlib.crc32(str(i).encode()) % 5 != 1][:n]


@pytest.mark.parametrize("contexts", [0, 2, 100])
def test_every_context_has_its_restaurant(spark, contexts):
    """Of words that occur once no seating is drawn, so the scores are known, however few contexts all parts know."""
    learned = "a b c d e f".split()
    texts = ["b c", "c b", "f", "e f new f", "new", "", None, "a b c d e f"]
    rows = [(trained_ids(1)[0], " ".join(learned)), *zip(held_out_ids(len(texts)), texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pitman_yor.score_texts(table, contexts=contexts, parts=3).collect()}
    chain = ["start", *learned, "end"]
    seen, v, d = set(zip(chain, chain[1:])), len(learned) + 1, 0.95
    base = (1 + d * v) / (v + 1)
    root = lambda w: ((1 - d) * (w in chain) + base) / (1 + v)

    def after(u, w):
        if u not in chain:
            return root(w)
        return ((1 - d) * ((u, w) in seen) + (1 + d) * root(w)) / 2

    for i, text in rows:
        tokens = ["start", *(text or "").split(), "end"]
        assert found[i]["score"] == pytest.approx(sum(math.log10(after(*pair)) for pair in zip(tokens, tokens[1:])))
    assert found[rows[0][0]]["train_tokens"] == v


def test_few_contexts_in_every_part_change_no_more_than_the_draws(spark):
    random = np.random.default_rng(4)
    pairs = lambda: " ".join(f"u{k} w{(7 * k + random.integers(2)) % 60}" for k in random.integers(0, 60, 40))
    ids = trained_ids(150) + held_out_ids(30)
    table = spark.createDataFrame([(i, pairs()) for i in ids], "doc_id long, text string")
    few, many = ({r["doc_id"]: r for r in pitman_yor.score_texts(table, contexts=c, parts=3).collect()} for c in (4, 500))
    for i in held_out_ids(30):
        assert few[i]["score"] == pytest.approx(many[i]["score"], rel=0.02)
        assert few[i]["score"] > 0.75 * few[i]["base_score"]


def test_probabilities_after_each_context_sum_to_one():
    random = np.random.default_rng(5)
    pairs = collections.Counter(zip((random.zipf(1.5, 4000) % 40).tolist(), (random.zipf(1.7, 4000) % 4).tolist()))
    dishes = sorted({(w, c) for w in range(40) for c in range(4)})
    words_, contexts = (np.array(x) for x in zip(*dishes))
    part = pitman_yor.Part(words_, contexts, np.array([pairs[d] for d in dishes]))
    vocabulary = int((part.word_count > 0).sum())
    customers = np.bincount(contexts, part.learned, 4)
    tables = np.bincount(contexts, part.learned > 0, 4).astype(float)
    customers[0] += tables[1:].sum()
    tables[0] = vocabulary
    shared = pitman_yor.Globals(customers, tables, vocabulary, 4000, (0.6, 0.7))
    for tables, served, root in pitman_yor._states(part, shared, random, 2, 3):
        own = customers.copy()
        own[0] = served.sum()
        by_context = np.bincount(contexts, tables, 4)
        by_context[0] = root.sum()
        state = pitman_yor.Globals(own, by_context, vocabulary, 4000, shared.discounts)
        at_root = state.at_root(served, root)
        found = state.after(contexts, part.learned, tables, at_root[words_])
        seen = part.word_count[words_] > 0
        unknown = state.after(np.arange(4), np.zeros(4), np.zeros(4), np.full(4, state.unknown))
        assert np.bincount(contexts[seen], found[seen], 4) + unknown == pytest.approx(np.ones(4))


def test_seatings_follow_the_restaurant():
    """Means of tables against the exact weights of partitions, and customers kept."""
    d, weight, customers = 0.6, 0.8, 5
    masses = collections.Counter()

    def partitions(n, most):
        if n == 0:
            yield ()
        for k in range(min(n, most), 0, -1):
            yield from ((k, *rest) for rest in partitions(n - k, k))

    for p in partitions(customers, customers):
        ways = math.factorial(customers)
        for k in p:
            ways //= math.factorial(k)
        for m in collections.Counter(p).values():
            ways //= math.factorial(m)
        mass = weight ** len(p)
        for k in p:
            mass *= math.prod(j - d for j in range(1, k))
        masses[len(p)] += ways * mass
    exact = sum(t * m for t, m in masses.items()) / sum(masses.values())
    seating = pitman_yor.Seating(np.full(4000, customers), d, np.random.default_rng(1))
    seating.seat(np.full(4000, weight))
    means = []
    for _ in range(8):
        seating.sweep(np.full(4000, weight))
        means.append(seating.tables.mean())
    assert np.mean(means[2:]) == pytest.approx(exact, abs=0.03)
    large = pitman_yor.Seating(np.array([1, 0, 5000, 90]), d, np.random.default_rng(1))
    large.seat(np.full(4, weight))
    large.sweep(np.full(4, weight))
    assert large.tables[:2].tolist() == [1, 0] and [s.sum() for s in large.sizes.values()] == [5000]
    assert 1 <= large.tables[3] <= 90


def test_numbers_of_tables_have_their_exact_distribution():
    """Against a walk over all seatings, one customer after another."""
    for d, weight, customers in ((0.6, 0.8, 6), (0.3, 5.0, 9), (0.9, 0.05, 7)):
        mass = np.zeros(customers + 1)

        def walk(sizes, left, product):
            if not left:
                mass[len(sizes)] += product
                return
            for i, k in enumerate(sizes):
                walk((*sizes[:i], k + 1, *sizes[i + 1:]), left - 1, product * (k - d))
            walk((*sizes, 1), left - 1, product * weight)

        walk((), customers, 1.0)
        exact = mass / mass.sum()
        ways = pitman_yor.log_ways(d)[customers, :customers + 1]
        shares = np.exp(ways + np.log(weight) * np.arange(customers + 1))
        assert shares / shares.sum() == pytest.approx(exact, abs=1e-12)
        seating = pitman_yor.Seating(np.full(20_000, customers), d, np.random.default_rng(2))
        seating.seat(np.full(20_000, weight))
        assert np.bincount(seating.tables, minlength=customers + 1) / 20_000 == pytest.approx(exact, abs=0.015)


# --- neighbours -------------------------------------------------------------

def test_probes_in_order_of_cost():
    f = np.array([0.1, 0.6, 0.45])
    cost = lambda steps: sum((f[i] if s < 0 else 1 - f[i]) ** 2 for i, s in steps)
    found = nearest.probe_order(f, 27)
    assert [cost(x) for x in found] == sorted(cost(x) for x in found)
    assert len({tuple(sorted(x)) for x in found}) == 27 == len(list(itertools.product((-1, 0, 1), repeat=3)))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 0.4 + rng.integers(0, 3, 300)[:, None]
    x[40:90] = x[40]  # many copies, some of them queries
    bad = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000 + 20 * i, v, "x") for i, v in enumerate(bad)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = nearest.search(vectors, vectors.filter("vec_id % 20 = 0"), k=5, part=16).collect()
    lists = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        lists[r["query_id"]].append((r["vec_id"], r["score"]))
    assert not any(q >= 1000 for q in lists)
    hits = 0
    for q in range(0, 300, 20):
        score = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in lists[q])
        hits += len(set(best) & {i for i, _ in lists[q]})
        if q in (40, 60, 80):
            assert [i for i, _ in lists[q]] == best
    assert hits >= 0.9 * 75
    assert nearest.search(vectors.limit(0), vectors.limit(0)).count() == 0
    assert nearest.search(vectors, vectors.filter("vec_id = 0"), k=400, width=50.0).count() == 299 - 50 + 50


# --- toxicity ---------------------------------------------------------------

def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    emission, offsets = rng.normal(size=9) * 3, np.array([0, 1, 5, 9])
    start, moves = rng.normal(size=2), rng.normal(size=(2, 2))
    p, pairs = toxicity.marginals(emission, offsets, start, moves)
    for a, b in zip(offsets, offsets[1:]):
        total, z = np.zeros(b - a), 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            s = math.exp(start[y[0]] + sum(emission[a + i] * t for i, t in enumerate(y))
                         + sum(moves[y[i - 1], y[i]] for i in range(1, b - a)))
            z, total = z + s, total + s * np.array(y)
        assert np.allclose(total / z, p[a:b])
    assert np.allclose(pairs[1] + pairs[3], np.where(np.isin(np.arange(9), offsets), 0, p))


def test_toxic_documents(spark, docs, none):
    rng = np.random.default_rng(5)
    names = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(rng.choice(names, 40)) + "." for _ in range(300)]
    toxic = [i % 4 == 0 for i in range(300)]
    texts = [f"{t[:60]} You Dolt{i % 7}, {t}" if bad else t for i, (t, bad) in enumerate(zip(texts, toxic))]
    given_docs = spark.createDataFrame(
        [(i, t, "en", "a", 0, "", "", 0) for i, t in enumerate(texts)] + [(500, "", "", "", 0, "", "", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(toxic)] + [(7, None), (None, 1), (900, 1)],
                                   "doc_id long, toxic int")
    tagger = toxicity.fit(given_docs, labels)
    found = toxicity.tag(given_docs, tagger, ["doc_id", "text"]).collect()
    for r in found:
        i = r["_row"]["doc_id"]
        assert (r["score"] >= 0.7) == (i < 300 and toxic[i]) and 0 <= r["score"] <= 1
        assert all("dolt" in r["_row"]["text"][s["start"]:s["stop"]].lower() for s in r["spans"])
        assert bool(r["spans"]) == (i < 300 and toxic[i])
    clean = toxicity.clean_documents(given_docs, labels)
    assert clean.columns == given_docs.columns and clean.count() == 301 - sum(toxic)
    assert toxicity.tag(docs, tagger, docs.columns).count() == len(rows_of())
    assert toxicity.clean_documents(none, labels).count() == 0
    assert toxicity.clean_documents(docs, labels.limit(0)).count() == len(rows_of())


# --- quality ----------------------------------------------------------------

def test_base_counts():
    texts = [r[1] or "" for r in rows_of()]
    found = quality.base_counts(pa.array(texts))
    for i, text in enumerate(texts):
        held = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = collections.Counter(zip(held, held[1:], held[2:]))
        covered = {k for j in range(len(held) - 2) if windows[tuple(held[j:j + 3])] > 1 for k in (j, j + 1, j + 2)}
        assert [int(found[c][i]) for c in quality.COUNTS] == [
            len(held), sum(map(len, held)), len(re.findall(quality.SYMBOLS, text)),
            len(lines) - len(set(lines)), len(covered)]


def test_probabilities_sum_to_one():
    codes, _ = quality.grams(pa.array(["abracadabra", "a cad", "", "aé\x00b"]))
    model = quality.KneserNey.of_counts(*np.unique(codes, return_counts=True))
    for context in np.unique(codes >> quality.BITS).tolist() + [12345]:
        every = (context << quality.BITS) + np.arange(1 << quality.BITS)
        assert model.probability(every).sum() == pytest.approx(1)
    assert len(np.unique(quality.mixed_hash(np.arange(1 << 16)))) == 1 << 16


def test_quality_keeps_prose(spark, docs, none):
    rng = np.random.default_rng(2)
    syllables = ["ta", "ri", "mon", "el", "os", "ve", "na", "du"]
    prose = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(120)) for _ in range(80)]
    junk = [re.sub(r"(\w+)", r"\1%%%", prose[0]), " ".join("qzx#" + "jk"[i % 2] * (i % 9) + str(i) for i in range(120))]
    rows = [(i, t, "en", "a", 0, "", "", 0) for i, t in enumerate(prose + junk + ["too short", PROSE * 9, None])]
    table = spark.createDataFrame(rows, SCHEMA)
    kept = {r["_row"]["doc_id"]: r["kept"] for r in quality.judge(table, ["doc_id"]).collect()}
    assert sum(kept[i] for i in range(80)) >= 79
    assert not any(kept[i] for i in range(80, 85))
    good = quality.good_documents(table)
    assert good.columns == table.columns and good.count() == sum(kept.values())
    assert quality.judge(docs, docs.columns).count() == len(rows_of())
    assert quality.judge(none, none.columns).count() == 0


# --- mixing -----------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeat=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= repeat * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: repeat * sizes[s] for s in full}
        left, open_ = left - sum(repeat * sizes[s] for s in full), open_ - full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 900, "b": 5000, "c": 10, "d": 0, None: 300}, {"é": 7, "z": 70, "Z": 700}, {"a": 1}, {"a": 0}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    expected = brute_targets(sizes)
    assert found == {s: pytest.approx(t) for s, t in expected.items()}


@given(st.lists(st.integers(0, 400), min_size=1, max_size=9), st.integers(0, 60))
@settings(max_examples=8, deadline=None)
def test_apportion_by_highest_quotients(spark, weights, seats):
    seats = seats if sum(weights) else 0
    table = spark.createDataFrame(list(enumerate(weights)), "party int, weight long")
    found = {r["party"]: r["quota"] for r in mixing.apportion(
        table, "weight", F.lit(seats), [], [F.col("party")]).collect()}
    quotients = sorted(((-w / (2 * k + 1), p) for p, w in enumerate(weights) for k in range(seats) if w))
    expected = collections.Counter(p for _, p in quotients[:seats])
    assert found == {p: expected[p] for p in range(len(weights))}


def test_mix(docs, none):
    found = mixing.mix(docs, block=4).collect()
    assert len(found) == len(rows_of())
    taken = collections.Counter()
    for r in found:
        row, m = r["_row"], r["mix"]
        assert m["size"] == len(WORD.findall(row["text"] or "")) and 0 <= m["taken"] <= 2 * m["size"]
        taken[row["source"]] += m["taken"]
    goals = {r["_row"]["source"]: r["mix"]["target"] for r in found}
    assert all(abs(taken[s] - t) <= 5 * 4 + 0.02 * t for s, t in goals.items())
    texts = mixing.mixed_documents(docs, block=4)
    assert texts.columns == docs.columns
    words_in = sum(len(WORD.findall(r["text"])) for r in texts.collect())
    assert words_in == sum(taken.values())
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    assert sorted(map(str, mixing.mix(docs, block=4).collect())) == sorted(map(str, found))


# --- near-duplicates --------------------------------------------------------

def brute_fingerprint(text):
    held = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(held[i:i + 4]) for i in range(max(1, len(held) - 3))] if held else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks, radius=4):
    group = {m: m for m in marks}
    for a, b in itertools.combinations(sorted(set(marks)), 2):
        if (a ^ b).bit_count() <= radius:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {m: new if g == old else g for m, g in group.items()}
    return group


def test_near_duplicates(spark, docs, none):
    found = simhash.near_duplicates(docs, tile=2).collect()
    marks = {(r[0], r[1]): brute_fingerprint(r[1]) for r in rows_of()}
    assert collections.Counter((r["doc_id"], r["fingerprint"] & (2**64 - 1)) for r in found) == collections.Counter(
        (r[0], marks[r[:2]]) for r in rows_of())
    group = brute_groups(list(marks.values()))
    least = {}
    for (d, _), m in marks.items():
        if d is not None:
            least[group[m]] = min(d, least.get(group[m], d))
    assert all(r["component_id"] == least.get(group[r["fingerprint"] & (2**64 - 1)]) for r in found)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(
        {(False, d) for d in least.values()} | {(True, 0)} - {(True, 0) if least.get(
            group[marks[(None, "lost and found")]]) is not None else ()})
    assert simhash.near_duplicates(none).count() == simhash.one_of_each(none).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 6))
@settings(max_examples=30, deadline=None)
def test_links_join_what_pairs_join(seeds, radius):
    marks = np.array(sorted({s ^ (1 << k) for s in seeds for k in (0, 1, 40)} | set(seeds)), np.uint64)
    a, b = simhash.links_between(marks[::2], marks[1::2], radius)
    group = {int(m): int(m) for m in marks}
    other = dict(group)

    def join(g, x, y):
        old, new = max(g[x], g[y]), min(g[x], g[y])
        for m in g:
            g[m] = new if g[m] == old else g[m]

    for x, y in itertools.product(marks[::2].tolist(), marks[1::2].tolist()):
        if (x ^ y).bit_count() <= radius:
            join(group, x, y)
    for x, y in zip(a.tolist(), b.tolist()):
        join(other, x, y)
    assert group == other


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 60), (60, 55), (60, 60), (70, 71), (71, 70)]
    found = {r["node"]: r["root"] for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, 50: 50, 60: 50, 55: 50, 70: 70, 71: 70}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
