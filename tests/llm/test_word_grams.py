"""The word model of the quality rules against brute force."""

import collections
import math
import pathlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from tannin.llm import pitman_yor, quality, word_grams
from tannin.llm.words import text_column

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_of(texts):
    chains = [["start", *WORD.findall(t or ""), "\n"] for t in texts]
    pairs = collections.Counter(p for c in chains for p in zip(c, c[1:]))
    total, after, follows = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for (u, w), n in pairs.items():
        total[u] += n
        after[u][min(n, 3)] += 1
        follows[w] += 1

    def found(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return [0.0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))]

    d, e = found(pairs.values()), found(follows.values())
    rest = sum(e[min(n, 3)] for n in follows.values()) / len(pairs)
    lower = {w: (n - e[min(n, 3)]) / len(pairs) + rest / len(follows) for w, n in follows.items()}

    def p(u, w):
        return (max(pairs[u, w] - d[min(pairs[u, w], 3)], 0) + sum(d[k] * n for k, n in after[u].items()) * lower[w]) / total[u]

    for u in list(total)[:20]:
        assert sum(p(u, w) for w in lower) == pytest.approx(1)
    return [-sum(math.log10(p(*pair)) for pair in zip(c, c[1:])) / (len(c) - 1) for c in chains]


@pytest.mark.parametrize("top", [0, 3, 40, 4095])
def test_perplexity_is_of_words(spark, monkeypatch, top):
    monkeypatch.setattr(word_grams, "STAYING", 5)
    random = np.random.default_rng(8)
    texts = [" ".join(f"w{k}é" for k in random.zipf(1.4, 80) % 150) for _ in range(60)]
    texts += [texts[0], texts[0], "日本 語 new", "new 日本", "A a", "", None, "one", " \n", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(text_column().alias("_text"))
    every = pa.array([t or "" for t in texts])
    for partitions, parts in ((1, 1), (5, 9)):
        model, apart = word_grams.fit(docs.repartition(partitions), top, parts)
        sums = {bytes(r["_digest"]): r["_apart"] for r in apart.collect()}
        kept, n = model.kept(every)
        found = [-(k + sums[d]) / c for k, d, c in zip(kept, word_grams.digests(every), n)]
        assert found == pytest.approx(expected_of(texts))


def test_judge_takes_word_pairs(spark):
    texts = ["日本 語 新 " * 5, "語 日本 新 " * 5, "新 新 新", "", None, "the cat sat", "the cat sat"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r[0]: r[1] for r in quality.judge(docs, ["doc_id"]).select("_row.doc_id", "log_perplexity").collect()}
    assert [found[i] for i in range(len(texts))] == pytest.approx(expected_of(texts))


def colliding(bits):
    """Words whose hashes share their first bits."""
    seen = collections.defaultdict(list)
    for k in range(120_000):
        seen[word_grams.word_hash(f"x{k}") >> 64 - bits].append(f"x{k}")
    return [words for words in seen.values() if len(words) > 1]


@pytest.mark.parametrize("most_shared", [1 << 18, 8])
def test_words_with_one_short_name_stay_apart(spark, monkeypatch, most_shared):
    monkeypatch.setattr(word_grams, "MOST_SHARED", most_shared)
    random = np.random.default_rng(4)
    pairs = colliding(word_grams.WIDTHS[0])[:8]
    assert len(pairs) == 8
    texts = [" ".join(random.choice(pairs[random.integers(8)][:2]) for _ in range(12)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(text_column().alias("_text"))
    found = word_grams.frequent_words(docs, 3)
    assert (found.bits, len(found.shared)) == ((28, 16) if most_shared > 8 else (32, 0))
    words = [w for pair in pairs for w in pair[:2]]
    assert len(set(found.named(words).tolist())) == 16
    model, apart = word_grams.fit(docs.repartition(3), 3, 5)
    sums = {bytes(r["_digest"]): r["_apart"] for r in apart.collect()}
    kept, n = model.kept(pa.array(texts))
    assert [-(k + sums[d]) / c for k, d, c in zip(kept, word_grams.digests(pa.array(texts)), n)] == pytest.approx(expected_of(texts))


def shuffled(spark):
    """Bytes of the shuffle files that the session holds, by file."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p: p.stat().st_size for d in dirs for p in pathlib.Path(d).rglob("shuffle_*.data")}


def test_pairs_are_held_once_and_in_few_bytes(spark, monkeypatch):
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in random.integers(0, 60_000, 1000)) for _ in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "_text string")
    held, bucketed, stored = shuffled(spark), word_grams._bucketed, []
    monkeypatch.setattr(word_grams, "_bucketed", lambda df, n: stored.append(bucketed(df, n)) or stored[-1])
    word_grams.fit(docs, 10)
    files = [pathlib.Path(f.removeprefix("file:")) for f in stored[0].inputFiles()]
    assert sum(f.stat().st_size for f in files) < 9 * 200_000
    time.sleep(1)
    assert sum(size for p, size in shuffled(spark).items() if p not in held) < 300_000


def test_pitman_yor_frees_its_shuffles(spark):
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in random.integers(0, 60_000, 1000)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = shuffled(spark)
    pitman_yor.score_texts(docs, contexts=10, rounds=1, burn_in=0, samples=1)
    time.sleep(1)
    assert sum(size for p, size in shuffled(spark).items() if p not in held) < 300_000
