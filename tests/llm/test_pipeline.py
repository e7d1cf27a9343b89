"""The pipeline's stages, each against the rows that its decision leaves."""

import collections
import itertools

import corpus_pipeline
import pytest

from surco.llm import mixing, substrings
from surco.llm.links import written


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        out.append(docs)
    return out


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes
    assert stages[5].columns == [*stages[0].columns, "token_ids", "n_tokens", "round_trip"]


def test_rejects_go_and_clean_documents_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    left = ids(stages[1])
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in left for d in good) >= 0.97 * len(good)
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in left for d in bad) <= 0.3 * len(bad)


def test_one_of_each_group_stays(stages):
    """The least id of every component of pairs whose sets of five words have 0.8 or more in common, by comparing all pairs."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for r in stages[1].collect():
        w = (r["text"] or "").encode().translate(lower).split()
        sets[r["doc_id"]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert ids(stages[2]) == collections.Counter(d for d in sets if top(d) == d)
    assert len(ids(stages[2])) < len(sets)


def test_passages_go(stages):
    want = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in substrings.remove_repeats(stages[2]).collect()}
    assert {r["doc_id"]: len((r["text"] or "").encode().split()) for r in stages[3].collect()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in stages[3].collect())


def test_mix_takes_its_words(stages):
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[3]).collect() if r["taken"]}
    got = collections.Counter()
    for r in stages[4].collect():
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert got == want


def test_ids_decode(stages):
    rows = stages[5].collect()
    assert rows and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_no_stage_runs_two_python_workers_a_core(spark, corpus):
    """Encoding and decoding follow one another; in one plan each core would hold two vocabularies and two batches."""
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars")
    plan = corpus_pipeline.encode(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") < 2


def test_odd_documents_pass_through(spark, corpus):
    """Nulls, empty and repeated rows, and clashing columns, through every stage; no labels reject nothing."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="surco-test-")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (corpus, corpus.limit(0)):
        n = docs.count()
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = written(stage(spark, docs, folder))
            if i == 0:
                assert docs.count() == n
            if i < 4:
                assert docs.columns == corpus.columns
        assert docs.filter("not round_trip").count() == 0
