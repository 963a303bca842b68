"""Batches above the operators' slice sizes give the rows that single documents give."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tannin.llm import bpe, pitman_yor, quality, simhash, token_counts, token_store, toxicity, words

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(words.UPPER, words.LOWER)
SIZE = 9 << 20


def texts():
    random = np.random.default_rng(7)
    vocabulary = np.array([f"{a}{b}{c}" for a in ("Tide", "sea", "über", "Kelp") for b in ("", "ward", "X")
                           for c in ("", ".", ",", "?", " #1")])
    found, held = [], 0
    while held < SIZE:
        text = "\n".join(" ".join(line) for line in random.choice(vocabulary, (int(random.integers(1, 1500)), 11)))
        found.append(text)
        held += len(text.encode())
    return [*found[:5], None, "", *found[5:], found[3]]


@pytest.fixture(scope="module")
def given():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, given, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("slices") / "documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(len(given))), "text": given, "lang": ["en"] * len(given)}), path)
    # one partition, and in it one batch
    return spark.read.parquet(path).coalesce(1)


def test_the_batch_is_cut(docs, given):
    largest = max(simhash.BATCH_BYTES, quality.BATCH_BYTES, token_store.BATCH_BYTES, token_counts.BATCH_BYTES,
                  toxicity.BATCH_BYTES, bpe.BLOCK_BYTES // 4, pitman_yor.BLOCK_BYTES)
    assert sum(len((t or "").encode()) for t in given) > largest and docs.rdd.getNumPartitions() == 1


def brute_fingerprint(text):
    found = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(found[i:i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    votes = [int((hashes >> np.uint64(i) & np.uint64(1)).sum()) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(shingles))


def test_fingerprints(docs, given):
    found = {r["doc_id"]: r["fingerprint"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert found == {i: brute_fingerprint(t) for i, t in enumerate(given)}


def test_token_ids(docs, given, tmp_path):
    library = Tokenizer.from_file(PATH)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(given)}
    counted = token_counts.token_counts(docs, PATH).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in counted} == {i: len(x) for i, x in ids.items()}
    encoded = bpe.encode(docs, PATH).select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256))
    assert {r[0]: r[1] for r in encoded.collect()} == {
        i: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for i, x in ids.items()}
    stored = token_store.read_store(token_store.write_store(docs, PATH)).select("doc_id", F.crc32("ids"))
    assert {r[0]: r[1] for r in stored.collect()} == {
        i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in ids.items()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_counts(docs, given):
    alone = docs.repartition(len(given))
    pick = lambda d: by_id(quality.judge(d, ["doc_id"]).select("_row.doc_id", *quality.COUNTS, "base_failed"))
    found = pick(docs)
    assert found == pick(alone)
    assert {i: r["n_words"] for i, r in found.items()} == {i: len(WORD.findall(t or "")) for i, t in enumerate(given)}


def test_toxicity_scores(docs, given):
    fitted = toxicity.fit_tagger(["calm kelp sea. " * 20, "vile tide kelp. " * 20] * 30, [0, 1] * 30)
    expected = [float(fitted.scores(p, w.offsets)[0]) for w, p in (
        fitted.tag(pa.array([t or ""])) for t in given)]
    found = by_id(toxicity.tag(docs, fitted, ["doc_id"]).select("_row.doc_id", "score"))
    assert [found[i]["score"] for i in range(len(given))] == pytest.approx(expected, rel=1e-9)


def test_model_counts(docs, given):
    found = by_id(pitman_yor.score_texts(docs, parts=4))
    assert {i: r["n_tokens"] for i, r in found.items()} == {
        i: len(WORD.findall(t or "")) + 1 for i, t in enumerate(given)}
