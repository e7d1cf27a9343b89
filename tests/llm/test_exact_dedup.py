"""Exact deduplication against a plain grouping by text."""

import collections
import hashlib

import pytest

from surco.llm import exact_dedup


def plain(rows):
    """doc_id, keep_id, size and digest of every row; kept is checked apart, since repeated rows are alike."""
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    last = {t: max((k for k in v if k is not None), default=None) for t, v in groups.items()}
    return sorted(((k, last[t], len(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for k in v), key=str)


def told(df):
    rows = df.collect()
    assert df.columns[1:] == ["keep_id", "group_size", "kept", "text_sha256"]
    per_text = collections.Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(per_text.values()) <= {1} and len(per_text) == len({r["text_sha256"] for r in rows})
    assert all(r[0] == r["keep_id"] for r in rows if r["kept"])
    return sorted(((r[0], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"digest_chars": 2}, {"batch_bytes": 1}, {"digest_chars": 2, "batch_bytes": 1}])
def test_same_as_grouping_by_text(spark, corpus, texts, tmp_path, options):
    """Also with digests of one byte, which many texts share, and one file a batch."""
    path = str(tmp_path / "docs")
    corpus.repartition(3).write.parquet(path)
    assert told(exact_dedup.deduplicate(spark, path, **options)) == plain(texts)


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_frequent_texts_are_dealt(spark, tmp_path, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i, "same") for i in range(300)] + [(1000 + i, f"t{i % 200}") for i in range(400)] + [(5000, None), (5001, "")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "n long, body string").repartition(4).write.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = exact_dedup.deduplicate(spark, path, "n", "body")
        assert df.columns[0] == "n" and told(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_state_goes_on_where_it_was(spark, tmp_path):
    """A second run over the same folder reads only the new files, and the state holds them all."""
    path, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    first, second = [(i, f"a{i % 7}") for i in range(20)], [(100 + i, f"a{i % 9}") for i in range(20)]
    settings = dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll
    spark.createDataFrame(first, "doc_id long, text string").write.parquet(path)
    assert told(exact_dedup.deduplicate(spark, path, folder=folder)) == plain(first)
    spark.createDataFrame(second, "doc_id long, text string").write.mode("append").parquet(path)
    assert told(exact_dedup.deduplicate(spark, path, folder=folder)) == plain(first + second)
    assert told(exact_dedup.deduplicate(spark, path, folder=folder)) == plain(first + second)  # nothing new
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll) == settings


def test_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "docs"))
    got = exact_dedup.deduplicate(spark, str(tmp_path / "docs"))
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_no_python_in_the_plan(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "docs"))
    path = str(tmp_path / "docs")
    held = exact_dedup.hold(spark, path, str(tmp_path / "state"), "doc_id", "text", 64, 1 << 30)
    seen = exact_dedup._seen(exact_dedup._rows(spark.read.parquet(path), "doc_id", "text", 64), held, 3)
    plan = exact_dedup._checked(seen)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
