"""The registered queries and the pipeline on the smallest data."""

import os
import subprocess
import sys

import numpy as np
import pytest

import __spark_entry__ as entry
import check_oracle
import corpus_pipeline
from tannin.llm import quality, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_all_are_registered():
    assert [f"op{n}_" for n in range(1, 14)] == sorted(
        (q.split("_")[0] + "_" for q in queries.QUERIES), key=lambda q: int(q[2:-1]))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    assert check_oracle.compare(spark, check_oracle.connect(FOLDER), FOLDER, name) == ""


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op1_url_filter", "op3_nearest", "op11_lexical_search", "op12_filter_audit")])
def test_query_has_a_row_per_document(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    ids = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in queries.table(spark, FOLDER, "documents").collect())


#: The base columns of the quality rules; the verdict of the model is none of SQL's.
BASE_SQL = r"""
    with texts as (select doc_id, coalesce(text, '') as text from documents),
    listed as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from texts),
    places as (select doc_id, words, unnest(range(1, len(words) + 1)) as i from listed),
    windows as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n
                from places where i + 2 <= len(words)),
    covered as (select doc_id, count(distinct i + k) as n from windows cross join range(3) r(k) where n > 1
                group by doc_id),
    lines as (select doc_id, unnest(string_split(text, chr(10))) as line from texts),
    repeated as (select doc_id, count(*) - count(distinct line) as n from lines
                 where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id)
    select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(r.n, 0) as n_dup_lines,
           coalesce(c.n, 0) as n_repeat_words,
           len(words) < 50 or 100 * coalesce(c.n, 0) > 50 * len(words) as base_failed
    from listed left join covered c using (doc_id) left join repeated r using (doc_id)"""


def test_base_columns_equal_sql(spark):
    names = ["doc_id", *quality.COUNTS, "base_failed"]
    found = queries.op5_quality(spark, FOLDER).select(*names).collect()
    expected = check_oracle.connect(FOLDER).execute(BASE_SQL).df()[names]
    assert sorted(map(tuple, found)) == sorted(expected.itertuples(index=False, name=None))


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_neighbours(spark, folder):
    folder = f"/root/testdata/{folder}"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    rows = queries.table(spark, folder, "embeddings").select("vec_id", "embedding").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    asked = ids % 20 == 0
    scores = vectors[asked] @ vectors.T
    scores[ids[asked][:, None] == ids] = -np.inf
    nearest = ids[np.argsort(-scores, axis=1, kind="stable")[:, :20]]
    exact = {(q, v) for q, near in zip(ids[asked].tolist(), nearest.tolist()) for v in near}
    found = queries.op3_nearest(spark, folder).collect()
    assert len({(r["query_id"], r["rank"]) for r in found}) == len(found) == len(exact)
    assert len({(r["query_id"], r["vec_id"]) for r in found} & exact) >= 0.92 * len(exact)


def test_workers_get_the_package(tmp_path):
    """From another folder, without the repository on the workers' path."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as entry\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print(entry.queries()['op9_token_counts'](spark, sys.argv[2]).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if "public_tokenizers" not in sys.modules:
        pytest.skip("no tokenizers")
    env["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(sys.modules["public_tokenizers"].__file__)))
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code, repo, FOLDER], cwd=tmp_path, env=env, timeout=300,
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 0


def test_pipeline(spark):
    docs = queries.table(spark, FOLDER, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, FOLDER).collect(), before.schema)
        assert docs.columns == columns
        assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}, name
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert encoded.count() == docs.count() > 0
