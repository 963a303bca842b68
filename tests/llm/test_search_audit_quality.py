"""Lexical search, filter audit and the classifier from trusted positives, against brute force."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tannin.llm import filter_audit, lexical, pu_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use inside, with other meanings.
MORE = ", n int, part string, score string, _row string, mask string, query string, rank string"
EXTRA = (7, "p", "s", "r", "m", "q", "k")


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], schema + MORE)


# --- lexical search ---------------------------------------------------------

TEXTS = [
    None, "", " .,! ", "kelp", "Kelp KELP kelp tide", "tide sea tide sea tide", "the sea, the tide and the kelp",
    "über Über 3.14 naïve", "sea " * 400 + "kelp", " ".join(f"w{i}" for i in range(6000)) + " kelp",
    "tide sea tide sea tide", "x", "don't", "日本語 kelp", "w17 w5999",
]
ITEMS = ["kelp tide", "the the sea kelp", "über naïve 3", None, "", "nothing here", "w17 w3 w999 日本語", "Kelp TIDE",
         "kelp tide"]


def brute_ranking(docs, items, k):
    terms = [(d, lexical.terms_of(t)) for d, t in docs]
    terms = [(d, collections.Counter(ts)) for d, ts in terms if ts]
    n_docs, total = len(terms), sum(sum(c.values()) for _, c in terms)
    holding = collections.Counter(t for _, c in terms for t in c)
    found = []
    for item, text in items:
        scored = []
        for d, c in terms:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(lexical.terms_of(text)))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        found += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(found)


@pytest.mark.parametrize("k, block_bytes, cells", [(50, 1 << 20, 1 << 22), (3, 16, 40), (1, 1 << 20, 1)])
def test_search(spark, k, block_bytes, cells):
    docs = [*enumerate(TEXTS), (4, TEXTS[4]), (None, "kelp tide"), (None, None)]
    items = [*enumerate(ITEMS), (None, "sea")]
    found = lexical.search(frame(spark, docs, "doc_id long, text string").repartition(3),
                           frame(spark, items, "item_id int, text string"), k, block_bytes, cells)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, found.collect())) == brute_ranking(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = "doc_id long, text string", "item_id int, text string"
    some = frame(spark, [(1, "kelp")], docs)
    assert lexical.search(frame(spark, [], docs), frame(spark, [(1, "kelp")], items)).count() == 0
    assert lexical.search(some, frame(spark, [], items)).count() == 0
    assert lexical.search(some, frame(spark, [(1, None)], items)).count() == 0


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8), st.integers(0, 3))
@settings(deadline=None, max_examples=60)
def test_split_terms(texts, start):
    given_ = pa.array(texts, pa.string())[start:]
    found = lexical.split_terms(given_)
    words = found.words.to_pylist()
    assert [words[a:b] for a, b in zip(found.offsets, found.offsets[1:])] == [
        lexical.terms_of(t) for t in given_.to_pylist()]


def test_bounds_are_bounds():
    random = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(200)]
    terms = [random.choice(200, 9, replace=False) for _ in range(20)]
    block = lexical.Block(0, list(range(20)), vocabulary, terms)
    corpus = lexical.Corpus(30, 5000, random.integers(0, 9000, 200))
    n, rows = random.integers(1, 300, 30), []
    for size in n:
        counts = collections.Counter(random.choice(200, size).tolist())
        if size % 3 == 0:
            counts[7] += 300
        tops: dict[int, int] = {}
        for code, count in counts.items():
            place = lexical._place(vocabulary[code])
            tops[place] = max(tops.get(place, 0), min(count, lexical.MOST))
        places = sorted(tops)
        rows.append((np.array(places, "<u2").tobytes(), bytes(tops[p] for p in places),
                     sorted(counts), [counts[c] for c in sorted(counts)]))
    places, tops, codes, counts = zip(*rows)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(n), pa.array(places), pa.array(tops), pa.array(codes, pa.list_(pa.int32())),
         pa.array(counts, pa.list_(pa.int32()))], ["n", "places", "tops", "codes", "counts"])
    part = lexical.Sketches(batch.slice(4), block, corpus)
    spans = corpus.spans(n[4:])
    for query, codes_of in enumerate(terms):
        exact = [sum(int(corpus.weights[c]) * int(lexical.impact(np.int64(k[list(o).index(c)]), spans[i]))
                     for c in codes_of if c in o) for i, (o, k) in enumerate(zip(codes[4:], counts[4:]))]
        assert part.scores(query, np.arange(26)).tolist() == exact
        assert (part.bounds(query) >= exact).all()


# --- filter audit -----------------------------------------------------------

PROSE = " ".join(f"word{i}" for i in range(120))
AUDITED = [
    (1, PROSE, "en"), (2, PROSE, "en"), (3, PROSE, "de"), (2, PROSE, "en"), (4, "short", "en"), (5, "", "en"),
    (6, None, None), (7, None, ""), (8, "A B " * 100, "en"), (9, PROSE + " #", "de"), (None, PROSE, "de"),
    (None, None, None), (1, PROSE, "en"), (10, "SHOUT " * 30 + PROSE, None), (11, " ".join(["x"] * 5000), "en"),
    (12, "ÄÖ " + PROSE, "fr"), (13, "a\x0bb c | " + PROSE.upper(), "fr"),
]
AUDIT_LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (9, None, 1), (None, 1, 1), (99, 1, 1), (13, 1, 0)]


def brute_audit(docs, labels):
    def fails(d, text):
        words = WORD.findall(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        smaller = d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs)
        return {f for f, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text),
            bool(set(text) & set("#$%&*|")), smaller)) if bad}

    marked = [(part or "", fails(d, t or ""), any(a == d and d is not None and q == 1 for a, q, _ in labels),
               any(a == d and d is not None and x == 1 for a, _, x in labels)) for d, t, part in docs]
    rows, shapley = {}, collections.Counter()
    for part in {m[0] for m in marked}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [m[1:] for m in marked if m[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[part, f] += len(gone)
                rows[part, order, step] = (
                    len(left), len(gone), sum(f in m[0] for m in every) - len(gone),
                    sum(m[0] == {f} for m in every), sum(m[1] for m in gone), sum(m[2] for m in gone))
    return {(p, o, s): (*row, shapley[p, o[s - 1]]) for (p, o, s), row in rows.items()}


def test_audit(spark):
    docs = frame(spark, AUDITED, "doc_id long, text string, lang string").repartition(3)
    labels = frame(spark, AUDIT_LABELS, "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in filter_audit.audit(docs, labels).collect()]
    expected = brute_audit(AUDITED, AUDIT_LABELS)
    assert len(found) == len(expected) == 4 * 600
    assert {r[:3]: r[3:] for r in found} == expected


def test_audit_of_nothing(spark):
    docs = frame(spark, [], "doc_id long, text string, lang string")
    labels = frame(spark, [], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(frame(spark, [(1, None, None)], "doc_id long, text string, lang string"), labels)
    assert one.count() == 600


@given(st.dictionaries(st.integers(0, 31), st.integers(1, 4)))
@settings(deadline=None, max_examples=30)
def test_swaps_keep_what_the_diagram_counts(counts):
    counts = {m: (n, n - 1, 0) for m, n in counts.items()}
    diagram = filter_audit.Diagram(counts)
    for level in (0, 3, 1, 2, 0, 0):
        diagram.swap(level)
        found = {}
        for mask in range(32):
            node = diagram.top
            for name in diagram.order:
                node = diagram.branches(node)[mask >> "ABCDE".index(name) & 1]
            if node:
                found[mask] = diagram.weights[node]
        assert found == counts


def test_all_orders_by_adjacent_swaps():
    for n in range(1, 6):
        order, seen = list(range(n)), set()
        for level in (None, *filter_audit.adjacent_swaps(n)):
            if level is not None:
                order[level:level + 2] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)
        assert len(list(filter_audit.adjacent_swaps(n))) == math.factorial(n) - 1


# --- quality from trusted positives -----------------------------------------

def good_and_bad(n, seed=5):
    random = np.random.default_rng(seed)
    sea = np.array(["kelp", "tide", "harbour", "gull", "salt", "wind", "sail", "rope", "north", "bay"])
    rows = []
    for i in range(n):
        words = random.choice(sea, int(random.integers(30, 90)))
        if i % 4:
            text = " ".join(words[:12]).capitalize() + ". " + " ".join(words[12:]) + "."
        else:
            text = (" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 60))[i % 3]
        rows.append((i, text, int(i % 4 > 0)))
    return rows


def test_held_out_quality(spark):
    rows = good_and_bad(1200)
    docs = frame(spark, [(i, t) for i, t, _ in rows], "doc_id long, text string")
    # trusted positives alone, as the method allows
    labels = frame(spark, [(i, 1) for i, _, y in rows if y and i % 2], "doc_id long, quality int")
    truth = {i: y for i, _, y in rows}
    found = [r for r in pu_quality.judge(docs, labels).select("_row.doc_id", "score").collect()
             if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(found) > 150 and all(0 <= r["score"] <= 1 for r in found)
    assert sum((r["score"] >= pu_quality.THRESHOLD) == truth[r["doc_id"]] for r in found) >= 0.97 * len(found)


def test_held_out_labels_and_negatives_are_not_used(spark):
    rows = good_and_bad(300)
    docs = frame(spark, [(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    one = [(i, y) for i, _, y in rows]
    other = [(i, 1 - y if i in held else (y or None)) for i, y in one]
    scores = [{r[0]: r[1] for r in pu_quality.judge(docs, frame(spark, given_, "doc_id long, quality int"))
               .select("_row.doc_id", "score").collect()} for given_ in (one, other)]
    assert scores[0] == pytest.approx(scores[1])


def test_odd_documents_have_scores(spark):
    rows = [(None, None), (1, ""), (1, "kelp"), (2, "x" * 200_000), (3, " \n\t"), (4, "日本語 " * 50), (4, "日本語 " * 50)]
    docs = frame(spark, rows, "doc_id long, text string")
    none = frame(spark, [], "doc_id long, quality int")
    found = pu_quality.judge(docs, none).collect()
    assert len(found) == len(rows) and {r["score"] for r in found} == {0.5}
    some = frame(spark, [(4, 1), (4, 1), (None, 1), (3, None)], "doc_id long, quality int")
    found = pu_quality.judge(docs, some).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert pu_quality.judge(frame(spark, [], "doc_id long, text string"), some).count() == 0


def test_features_of_slices():
    texts = pa.array([t for _, t, _ in good_and_bad(20)] + [None, "", "ü"])
    assert np.array_equal(pu_quality.features_of(texts)[7:], pu_quality.features_of(texts[7:]))
    alone = [pu_quality.features_of(texts[i:i + 1])[0] for i in range(len(texts))]
    assert np.allclose(pu_quality.features_of(texts), alone)
    assert np.isfinite(alone).all()


def test_the_prior_is_found():
    random = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.8):
        good, bad = random.normal(1, 0.3, 40000), random.normal(0, 0.3, 40000)
        every = np.concatenate([good[:int(20000 * prior)], bad[:int(20000 * (1 - prior))]])
        bins = [np.histogram(x, 500, (-2, 3))[0] for x in (random.normal(1, 0.3, 20000), every)]
        assert pu_quality.class_prior(*bins) == pytest.approx(prior, abs=0.05)


def risk(weights, trusted, every, prior):
    """The non-negative risk, from the rows themselves."""
    loss = lambda x, y: np.mean((x @ weights * y - 1) ** 2 / 4)
    return prior * loss(trusted, 1) + max(0.0, loss(every, -1) - prior * loss(trusted, -1))


@pytest.mark.parametrize("prior", (0.3, 0.9))
def test_the_risk_is_least(prior):
    random = np.random.default_rng(2)
    ones = np.ones((60, 1))
    trusted = np.hstack([ones, random.normal(1, 1, (60, 3))])
    every = np.hstack([ones, random.normal(0.2, 1, (60, 3))])
    weights = pu_quality.non_negative_fit(
        trusted.T @ trusted / 60, every.T @ every / 60, prior, penalty=1e-9, rounds=20000)
    least = risk(weights, trusted, every, prior)
    for _ in range(300):
        assert risk(weights + random.normal(0, 0.05, 4), trusted, every, prior) >= least - 1e-4
