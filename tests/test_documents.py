"""Chunks, vectors and forecasts on small cases."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from surco.functions.columns import ntz
from surco.operators import documents as dc, forecast as fc

GAPS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        　"


def plain_chunks(text, size=50, overlap=5):
    words = text.split()
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size - overlap)]


@pytest.mark.parametrize("n", [0, 1, 45, 46, 50, 51, 95, 96])
def test_chunk_edges(spark, n):
    text = "  " + " \n".join(f"w{i}" for i in range(n)) + "\t"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [r.texto for r in dc.chunk_words(df).orderBy("pos").collect()]
    assert got == plain_chunks(text)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab" + GAPS, max_size=60), min_size=1, max_size=30))
def test_chunks_follow_any_white_space(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in dc.chunk_words(df, size=4, overlap=1).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.texto)
    assert got == {i: plain_chunks(t, 4, 1) for i, t in enumerate(texts) if t.split()}


def test_all_white_space_separates(spark):
    df = spark.createDataFrame([(1, "x".join(GAPS))], "id int, text string")
    assert dc.chunk_words(df, size=100, overlap=0).first().texto == " ".join("x" * (len(GAPS) - 1))


def test_model_gets_small_batches(spark):
    def model(texts):
        assert len(texts) <= 7
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.range(40).select(F.repeat(F.lit("a"), F.col("id").cast("int")).alias("texto"))
    out = dc.embed(df, model, batch=7).collect()
    assert sorted(r.embedding[0] for r in out) == [float(i) for i in range(40)]


def store(spark):
    data = [("a", "maiz", [1.0, 0.0]), ("b", "maiz", [1.0, 1.0]), ("c", "olivo", [0.0, 1.0]), ("d", "olivo", [0.0, 0.0]), ("e", "maiz", [2.0, 0.0])]
    return spark.createDataFrame([(k, f"docs/{k}", c, "t" + k, v) for k, c, v in data],
                                 "chunk_id string, doc_path string, cultivo string, texto string, embedding array<double>")


def test_top_k_ties_filter_and_zero_vector(spark):
    hits = dc.cosine_topk(store(spark), [1.0, 0.0], 3)
    assert [(r.chunk_id, r.score) for r in hits.collect()] == [("a", 1.0), ("e", 1.0), ("b", 0.7071)]
    assert dc.cosine_topk(store(spark), [1.0, 0.0], 3, {"cultivo": "vid"}).count() == 0
    everything = dc.cosine_topk(store(spark), [1.0, 0.0], 99).collect()
    assert len(everything) == 5 and everything[-1].chunk_id == "d" and everything[-1].score is None


def test_top_k_by_crop_and_context(spark):
    queries = spark.createDataFrame([("q1", "maiz", [1.0, 0.1]), ("q2", "olivo", [0.0, 2.0])], "query_id string, cultivo string, vector array<double>")
    hits = dc.cosine_topk_by_crop(store(spark), queries, 2)
    assert rows(hits, "query_id", "chunk_id", "puesto") == [("q1", "a", 1), ("q1", "e", 2), ("q2", "c", 1), ("q2", "d", 2)]
    context = dc.retrieved_context(hits.withColumn("titulo", F.lit("")), ["query_id"]).orderBy("query_id").collect()
    assert context[0].resultado == "ta\n\n---\n\nte" and context[0].fuentes == ["docs/a", "docs/e"]


def test_ingest_is_repeatable_and_reingest_replaces(spark):
    docs = spark.createDataFrame([("docs/x/a.pdf", "x", None, None, "uno dos " * 60), ("docs/x/b.pdf", "x", "g", "T", "tres")],
                                 "doc_path string, cultivo string, tipo_doc string, titulo string, text string")
    when = ntz("2024-01-01 00:00:00")
    first = dc.ingest_documents(docs, when)
    assert rows(first, "chunk_id") == rows(dc.ingest_documents(docs.repartition(3), when), "chunk_id")
    assert {r.titulo for r in first.collect()} == {"a.pdf", "T"}
    again = dc.reingest(first, docs.filter("cultivo = 'x' AND titulo = 'T'").withColumn("text", F.lit("cuatro cinco")), when)
    assert rows(again.filter("titulo = 'T'"), "texto") == [("cuatro cinco",)]
    assert again.count() == first.count()
    assert dc.semantic_query(first, "tres", 1).first().doc_path == "docs/x/b.pdf"
    with pytest.raises(ValueError):
        dc.semantic_query(first, "  ")


def test_file_catalogue(spark, tmp_path):
    from surco.sources.tables import document_files

    folder = tmp_path / "docs" / "olivo"
    folder.mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"x" * 1536)
    (folder / "b.txt").write_bytes(b"x")
    out = document_files(spark, str(tmp_path)).collect()
    assert [(r.doc_path.rsplit("/", 1)[1], r.size_kb) for r in out] == [("a.pdf", 1.5)]


# ---- forecasts ------------------------------------------------------------

def seasonal(spark, n=1100):
    start = date(2020, 1, 1)
    data = []
    for i in range(n):
        wave = math.sin(2 * math.pi * i / 365.25)
        data.append(("p", start + timedelta(days=i), "historico_era5", 4 + 2 * wave, max(0.0, 2 - 3 * wave)))
    data.append(("p", start + timedelta(days=n + 50), "forecast", 99.0, 99.0))
    return spark.createDataFrame(data, "parcela_id string, fecha date, fuente string, et0_mm double, precipitacion_mm double")


def test_forecast_follows_the_season_and_ignores_forecast_rows(spark):
    series = fc.training_series(seasonal(spark))
    assert series.count() == 2200
    out = fc.fit_predict(series).orderBy("target", "fecha").collect()
    assert len(out) == 28
    et0 = [r for r in out if r.target == "et0"]
    assert et0[0].fecha == date(2020, 1, 1) + timedelta(days=1100)
    for i, r in enumerate(et0):
        assert r.p25 <= r.p50 <= r.p75
        assert r.p50 == pytest.approx(4 + 2 * math.sin(2 * math.pi * (1100 + i) / 365.25), abs=0.25)
    assert all(r.p25 >= 0 for r in out)
    wide = fc.quantiles_wide(fc.fit_predict(series)).orderBy("fecha").collect()
    assert [w.et0_p50 for w in wide] == [r.p50 for r in et0]


def test_walk_forward_cutoffs(spark):
    out = fc.walk_forward(fc.training_series(seasonal(spark)), initial=730, period=90, horizon=14)
    cuts = sorted({r.corte for r in out.filter("target = 'et0'").collect()})
    last = date(2020, 1, 1) + timedelta(days=1099)
    assert cuts[-1] == last - timedelta(days=14)
    assert all((b - a).days == 90 for a, b in zip(cuts, cuts[1:]))
    assert (cuts[0] - date(2020, 1, 1)).days >= 730 and (cuts[0] - timedelta(days=90) - date(2020, 1, 1)).days < 730
    errors = fc.forecast_errors(out.filter("target = 'et0'")).first()
    assert errors.mae < 0.3 and errors.rmse >= errors.mae


def test_error_measures(spark):
    df = spark.createDataFrame([("t", 1, 2.0, 1.0), ("t", 1, 4.0, 7.0), ("t", 2, 5.0, 5.0)], "target string, horizonte int, y double, yhat double")
    got = fc.forecast_errors(df).first()
    assert got.mae == pytest.approx((2.0 + 0) / 2)
    assert got.rmse == pytest.approx(np.sqrt(5.0) / 2)
    assert got.mape == pytest.approx((0.5 + 0.75) / 2 / 2)


@pytest.mark.parametrize("block", [2048, 3])
def test_many_queries_against_every_pair(spark, monkeypatch, block):
    """Filters of every kind, copies of one vector, vectors without direction, more queries than a block holds."""
    import numpy as np

    monkeypatch.setattr(dc, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=4).tolist() for _ in range(60)] + [[1.0, 2.0, 0.5, -1.0]] * 40
    vectors += [None, [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [1.0, 2.0], []]
    chunks = [(f"c{i:03d}", f"crop{i % 3}" if i % 7 else None, f"t{i % 2}", v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(chunks, "chunk_id string, cultivo string, tipo_doc string, embedding array<double>").repartition(5)
    asked = [(i, rng.normal(size=4).tolist() if i % 4 else [1.0, 2.0, 0.5, -1.0], f"crop{i % 4}" if i % 3 == 0 else None, f"t{i % 2}" if i % 3 == 1 else None)
             for i in range(12)] + [(90, None, None, None), (91, [0.0] * 4, None, None), (92, [3.0, 1.0], None, None)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>, cultivo string, tipo_doc string")
    want = []
    for q, v, crop, kind in asked:
        hits = []
        for c, at, of, e in chunks:
            fits = (crop is None or crop == at) and (kind is None or kind == of)
            if not fits:
                continue
            if not v or not e or None in e or len(e) != len(v) or not np.isfinite(e).all() or not any(e) or not any(v):
                hits.append((2.0, c))
                continue
            a, b = np.array(e) / np.linalg.norm(e), np.array(v) / np.linalg.norm(v)
            hits.append((-round(float((a * b).sum()), 12), c))
        want += [(q, i + 1, c, None if s == 2.0 else round(-s, 4)) for i, (s, c) in enumerate(sorted(hits)[:4])]
    out = dc.cosine_topk_many(df, queries, 4)
    assert sorted((r.query_id, r.puesto, r.chunk_id, r.score) for r in out.collect()) == sorted(want)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert dc.cosine_topk_many(df, queries.limit(0), 4).count() == 0 and dc.cosine_topk_many(df.limit(0), queries, 4).count() == 0


def test_default_vectors_by_hand():
    import hashlib

    texts = ["Uno dos  UNO", "", "ñandú\tdos", "  "]
    for text, got in zip(texts, dc.hashed_vectors(16)(texts)):
        want = [0.0] * 16
        for word in text.lower().split():
            code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            want[code % 16] += 1 if code >= 2**31 else -1
        assert got.tolist() == want


def test_hits_of_one_question_carry_their_rank(spark):
    hits = dc.cosine_topk(store(spark), [1.0, 0.0], 3)
    assert [r.puesto for r in hits.orderBy("puesto").collect()] == [1, 2, 3]
    context = dc.retrieved_context(hits.withColumn("titulo", F.lit(""))).collect()
    assert context[0].resultado.split("\n\n---\n\n") == [r.texto for r in hits.orderBy("puesto").collect()]
