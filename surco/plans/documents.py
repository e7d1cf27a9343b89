"""Queries over documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators import documents as dc
from ..operators.tables import delete_by_key, deleted_by_key
from ..sources.tables import load
from .registry import query
from .roles import AS_OF

# The word separators, in the pattern syntax of the SQL engine.
SPACES = (
    r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def chunk_sql(size: int = 50, overlap: int = 5) -> str:
    return f"""words AS (
  SELECT doc_id, lang, source, n_chars, [x FOR x IN regexp_split_to_array(text, '{SPACES}') IF x <> ''] AS w FROM documents),
starts AS (SELECT *, unnest(range(0, len(w), {size - overlap})) AS i FROM words),
chunks AS (
  SELECT doc_id, lang, source, n_chars, CAST(i // {size - overlap} AS INTEGER) AS pos,
         array_to_string(list_slice(w, i + 1, i + {size}), ' ') AS texto FROM starts)"""


@query(f"WITH {chunk_sql()} SELECT doc_id, pos, texto FROM chunks")
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return dc.chunk_words(load(spark, d, "documents").select("doc_id", "text"))


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Documents with path, crop, kind and title."""
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return load(spark, d, "documents").select(
        path.alias("doc_path"), F.col("lang").alias("cultivo"), F.col("source").alias("tipo_doc"),
        F.when(F.col("n_chars") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("titulo"),
        "text",
    )


def hashed_sql(table: str, keys: str, text: str, dim: int = 64, into: str = "vectors") -> str:
    """`keys, v`: the vectors of the default model for the texts of a table."""
    return f"""{into}_codes AS (
  SELECT {keys}, CAST('0x' || left(md5(w), 8) AS BIGINT) AS code
  FROM (SELECT {keys}, unnest(string_split(lower({text}), ' ')) AS w FROM {table}) WHERE w <> ''),
{into}_sums AS (
  SELECT {keys}, code % {dim} AS bucket, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END) AS x FROM {into}_codes GROUP BY ALL),
{into} AS (
  SELECT {keys}, list_transform(range({dim}), lambda i: CAST(coalesce(map_from_entries(m)[i], 0) AS DOUBLE)) AS v
  FROM (SELECT {keys}, list((bucket, x)) AS m FROM {into}_sums GROUP BY ALL))"""


PATH = "'docs/' || lang || '/' || doc_id || '.pdf'"


@query(f"""
WITH {chunk_sql()}, {hashed_sql("chunks", "doc_id, pos", "texto")}
SELECT sha256({PATH} || chr(31) || pos) AS chunk_id, {PATH} AS doc_path, lang AS cultivo, source AS tipo_doc,
       CASE WHEN n_chars % 2 = 0 THEN doc_id || '.pdf' ELSE 't' || doc_id END AS titulo, texto,
       array_to_string([CAST(x AS INTEGER) FOR x IN v], ',') AS vector, TIMESTAMP '{AS_OF}' AS created_at
FROM chunks JOIN vectors USING (doc_id, pos)
""")
def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their vectors, as text."""
    rows = dc.ingest_documents(papers(spark, d), ntz(AS_OF))
    return rows.withColumn("vector", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")).drop("embedding")


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """Chunk rows without vectors, indexed at a time that depends on the document."""
    rows = dc.chunk_words(load(spark, d, "documents"))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("n_chars"))
    return rows.select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("doc_path"), "doc_id",
        F.col("lang").alias("cultivo"), F.col("source").alias("tipo_doc"), "pos", "texto",
        (ntz(AS_OF) + seconds).alias("created_at"),
    )


INDEXED = f"""indexed AS (
  SELECT lang || '/' || doc_id AS doc_path, doc_id, lang AS cultivo, source AS tipo_doc, pos, texto,
         TIMESTAMP '{AS_OF}' + n_chars * INTERVAL 1 SECOND AS created_at FROM chunks)"""


@query(f"""
WITH {chunk_sql()}, {INDEXED}
SELECT doc_path, cultivo, tipo_doc, count(*) AS chunks, max(created_at) AS indexed_at FROM indexed GROUP BY ALL
""")
def document_inventory(spark: SparkSession, d: str) -> DataFrame:
    return dc.document_inventory(indexed(spark, d))


@query(f"""
WITH {chunk_sql()}, {INDEXED}, inv AS (
  SELECT doc_path, cultivo, tipo_doc, count(*) AS chunks, max(created_at) AS indexed_at FROM indexed GROUP BY ALL),
files AS (SELECT 'en/' || doc_id AS doc_path, round((quality + 1) * doc_id / 1024.0, 1) AS size_kb FROM labels)
SELECT doc_path, cultivo, tipo_doc, chunks, indexed_at, size_kb FROM inv FULL OUTER JOIN files USING (doc_path)
""")
def document_listing(spark: SparkSession, d: str) -> DataFrame:
    """Indexed documents beside files; labels stand for the file catalogue."""
    files = load(spark, d, "labels").select(
        F.concat(F.lit("en/"), F.col("doc_id").cast("string")).alias("doc_path"),
        F.round((F.col("quality") + 1) * F.col("doc_id") / 1024.0, 1).alias("size_kb"),
    )
    return dc.list_documents(indexed(spark, d), files)


@query(f"""
WITH {chunk_sql()}, {INDEXED}, doomed AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT doc_path, count(*) AS chunks, bool_or(doc_id IN (SELECT * FROM doomed)) AS borrado FROM indexed GROUP BY 1
""")
def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks per document that a delete keeps, and that it removes."""
    store = indexed(spark, d)
    doomed = load(spark, d, "labels").filter(F.col("toxic") == 1).select("doc_id")
    parts = [
        f(store, doomed, ["doc_id"]).groupBy("doc_path").agg(F.count(F.lit(1)).alias("chunks")).withColumn("borrado", F.lit(gone))
        for f, gone in ((delete_by_key, False), (deleted_by_key, True))
    ]
    return parts[0].unionByName(parts[1])


@query(f"""
WITH {chunk_sql()}, renewed AS (SELECT doc_id FROM labels WHERE quality = 1),
starts2 AS (SELECT *, unnest(range(0, len(w), 90)) AS i2 FROM words WHERE doc_id IN (SELECT * FROM renewed)),
store AS (
  SELECT doc_id, pos, texto FROM chunks WHERE doc_id NOT IN (SELECT * FROM renewed)
  UNION ALL
  SELECT doc_id, CAST(i2 // 90 AS INTEGER), array_to_string(list_slice(w, i2 + 1, i2 + 100), ' ') FROM starts2)
SELECT doc_id, pos, texto FROM store
""")
def replace_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of good quality are cut again into longer chunks."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    good = load(spark, d, "labels").filter(F.col("quality") == 1).select("doc_id")
    longer = dc.chunk_words(docs.join(good, "doc_id", "left_semi"), size=100, overlap=10)
    return dc.replace_by_key(dc.chunk_words(docs), longer, "doc_id")


# ---- vectors --------------------------------------------------------------

def vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("vec_id")
    return load(spark, d, "embeddings").select(
        key.alias("chunk_id"), F.concat(F.lit("doc"), F.floor(key / 5).cast("string")).alias("doc_path"),
        F.col("label").cast("string").alias("cultivo"), F.concat(F.lit("texto "), key.cast("string")).alias("texto"),
        "embedding",
    )


def mean_vectors(chunks: DataFrame, *keys: str) -> DataFrame:
    """Mean vector per key: averaged per position, so a task never holds many vectors."""
    cells = chunks.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return lists.select(*keys, F.col("v.m").alias("vector"))


MEANS = """cells AS (
  SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
"""


@query(f"""
WITH {MEANS} m AS (SELECT pos, avg(x) AS m FROM cells GROUP BY pos), q AS (SELECT list(m ORDER BY pos) AS v FROM m)
SELECT vec_id AS chunk_id, 'doc' || vec_id // 5 AS doc_path, CAST(label AS VARCHAR) AS cultivo, 'texto ' || vec_id AS texto,
       round(list_cosine_similarity(embedding::DOUBLE[], v), 4) AS score,
       CAST(row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS INTEGER) AS puesto
FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10
""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to the mean of all."""
    chunks = vector_chunks(spark, d)
    return dc.cosine_topk(chunks, mean_vectors(chunks).scalar(), 10)


BY_CROP = f"""WITH {MEANS} m AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY ALL),
q AS (SELECT label, list(m ORDER BY pos) AS v FROM m GROUP BY label),
hits AS (
  SELECT CAST(e.label AS VARCHAR) AS cultivo, vec_id AS chunk_id, 'doc' || vec_id // 5 AS doc_path, 'texto ' || vec_id AS texto,
         'q' || e.label AS query_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 4) AS score,
         CAST(row_number() OVER (PARTITION BY e.label ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS INTEGER) AS puesto
  FROM embeddings e JOIN q USING (label) QUALIFY puesto <= 3)"""


def crop_hits(spark: SparkSession, d: str) -> DataFrame:
    chunks = vector_chunks(spark, d)
    queries = mean_vectors(chunks, "cultivo").withColumn("query_id", F.concat(F.lit("q"), "cultivo"))
    return dc.cosine_topk_by_crop(chunks, queries, 3)


@query(BY_CROP + " SELECT * FROM hits")
def cosine_topk_by_crop(spark: SparkSession, d: str) -> DataFrame:
    return crop_hits(spark, d)


@query(BY_CROP + """
SELECT query_id, string_agg(texto, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY puesto) AS resultado,
       array_to_string(list_sort(list(DISTINCT doc_path)), ',') AS fuentes FROM hits GROUP BY 1
""")
def retrieved_context(spark: SparkSession, d: str) -> DataFrame:
    hits = crop_hits(spark, d).withColumn("titulo", F.lit(""))
    out = dc.retrieved_context(hits, ["query_id"])
    return out.withColumn("fuentes", F.array_join("fuentes", ","))


@query(f"""
WITH {MEANS} m AS (SELECT pos, avg(x) AS m FROM cells GROUP BY pos), q AS (SELECT list(m ORDER BY pos) AS v FROM m),
hits AS (
  SELECT 'doc' || vec_id // 5 AS doc_path, 'texto ' || vec_id AS texto,
         row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS puesto
  FROM embeddings, q QUALIFY puesto <= 10)
SELECT string_agg(texto, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY puesto) AS resultado,
       array_to_string(list_sort(list(DISTINCT doc_path)), ',') AS fuentes FROM hits
""")
def context_of_one(spark: SparkSession, d: str) -> DataFrame:
    """The hits of one question, in their rank, as the text that an answer is built on."""
    chunks = vector_chunks(spark, d)
    hits = dc.cosine_topk(chunks, mean_vectors(chunks).scalar(), 10).withColumn("titulo", F.lit(""))
    return dc.retrieved_context(hits).withColumn("fuentes", F.array_join("fuentes", ","))


KINDS = 20


@query(f"""
WITH {MEANS} kinds AS (SELECT *, vec_id % {KINDS} AS kind FROM cells),
m AS (SELECT label, kind, pos, avg(x) AS m FROM kinds GROUP BY ALL),
q AS (SELECT label, kind, (label + kind) % 3 AS asks, list(m ORDER BY pos) AS v FROM m GROUP BY ALL)
SELECT q.label * {KINDS} + q.kind AS query_id, vec_id AS chunk_id, 'doc' || vec_id // 5 AS doc_path, CAST(e.label AS VARCHAR) AS cultivo,
       't' || vec_id % {KINDS} AS tipo_doc, 'texto ' || vec_id AS texto, round(list_cosine_similarity(embedding::DOUBLE[], v), 4) AS score,
       CAST(row_number() OVER (PARTITION BY q.label, q.kind ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS INTEGER) AS puesto
FROM embeddings e JOIN q ON (asks <> 0 OR q.label = e.label) AND (asks <> 1 OR q.kind = vec_id % {KINDS}) QUALIFY puesto <= 5
""")
def cosine_topk_many(spark: SparkSession, d: str) -> DataFrame:
    """A question per crop and kind: a third of them name the crop, a third the kind, a third neither."""
    kind = F.col("chunk_id") % KINDS
    chunks = vector_chunks(spark, d).withColumn("tipo_doc", F.concat(F.lit("t"), kind.cast("string")))
    means = mean_vectors(chunks.withColumn("kind", kind), "cultivo", "kind")
    crop = F.col("cultivo").cast("long")
    asks = (crop + F.col("kind")) % 3
    queries = means.select(
        (crop * KINDS + F.col("kind")).alias("query_id"), "vector", F.when(asks == 0, F.col("cultivo")).alias("cultivo"),
        F.when(asks == 1, F.concat(F.lit("t"), F.col("kind").cast("string"))).alias("tipo_doc"))
    return dc.cosine_topk_many(chunks, queries, 5)


QUESTION = "the of and with"


@query(f"""
WITH {chunk_sql()}, {hashed_sql("chunks", "doc_id, pos", "texto")},
question AS (SELECT 0 AS one, '{QUESTION}' AS texto), {hashed_sql("question", "one", "texto", into="asked")},
scored AS (
  SELECT doc_id, pos, list_dot_product(vectors.v, asked.v) / (sqrt(list_dot_product(vectors.v, vectors.v)) * sqrt(list_dot_product(asked.v, asked.v))) AS cosine
  FROM vectors, asked),
ranked AS (
  SELECT sha256({PATH} || chr(31) || pos) AS chunk_id, {PATH} AS doc_path, lang AS cultivo, source AS tipo_doc,
         CASE WHEN n_chars % 2 = 0 THEN doc_id || '.pdf' ELSE 't' || doc_id END AS titulo, texto, TIMESTAMP '{AS_OF}' AS created_at,
         1 - cosine AS distance
  FROM chunks JOIN scored USING (doc_id, pos))
SELECT * EXCLUDE (distance), round(1 - distance, 4) AS score,
       CAST(row_number() OVER (ORDER BY distance NULLS LAST, chunk_id) AS INTEGER) AS puesto
FROM ranked ORDER BY puesto LIMIT 5
""")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Embed every chunk of every document with the offline model, then search."""
    return dc.semantic_query(dc.ingest_documents(papers(spark, d), ntz(AS_OF)), QUESTION, 5)
