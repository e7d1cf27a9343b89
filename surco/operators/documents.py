"""Documents: word chunks, embeddings, vector search and inventory."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.fixed_values import WHITE_SPACE, WHITE_SPACE_CHARS
from ..functions.vectors import cosine_distance
from .tables import replace_by_key

EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]


def chunk_words(docs: DataFrame, text: str = "text", size: int = 50, overlap: int = 5) -> DataFrame:
    """Overlapping word chunks of whole texts, numbered from 0.

    A chunk starts every `size - overlap` words as long as words are left.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    stride = size - overlap
    keep = [c for c in docs.columns if c != text]
    # Trimmed, a text that is not blank splits without empty words.
    trimmed = F.btrim(text, F.lit(WHITE_SPACE_CHARS))
    words = docs.filter(trimmed != "").select(*keep, F.split(trimmed, WHITE_SPACE).alias("_words"))
    starts = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(stride))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice("_words", i + 1, F.lit(size)), " "))
    return words.select(*keep, F.posexplode(chunks).alias("pos", "texto"))


def hashed_vectors(dim: int = 64) -> EmbedFn:
    """A model-free default: word counts folded into `dim` signed buckets.

    The first eight hex digits of a word's MD5 are its number: modulo `dim` the
    bucket, its highest bit the sign. Digests are taken once per distinct word.
    """

    def run(texts: list[str]) -> np.ndarray:
        words = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
        coded = words.flatten().dictionary_encode()
        known = [w or "" for w in coded.dictionary.to_pylist()]
        codes = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in known] or [0])[coded.indices.to_numpy()]
        real = np.array([w != "" for w in known] or [True])[coded.indices.to_numpy()]
        signs = np.where(codes >> 31, 1.0, -1.0) * real
        return np.bincount(of * dim + codes % dim, weights=signs, minlength=len(texts) * dim).reshape(-1, dim)

    return run


def embed(df: DataFrame, fn: EmbedFn | None = None, text: str = "texto", into: str = "embedding",
          batch: int = 125) -> DataFrame:
    """Add one vector per text; a given model gets at most `batch` texts per call, the default all that arrive together."""
    model, most = fn or hashed_vectors(), batch if fn else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for at in range(0, len(frame), most or max(1, len(frame))):
                texts = frame[text].iloc[at : at + (most or len(frame))].tolist()
                vectors += [np.asarray(v, dtype=float) for v in model(texts)]
            yield frame.assign(**{into: vectors})

    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def ingest_documents(docs: DataFrame, created_at: Column, fn: EmbedFn | None = None, size: int = 50,
                     overlap: int = 5) -> DataFrame:
    """Chunk rows with vectors, ready to append.

    Documents bring doc_path, cultivo, tipo_doc, titulo and text. The chunk id
    follows from path and position, so a repeated run makes the same rows.
    """
    named = docs.withColumn("titulo", F.coalesce(F.nullif("titulo", F.lit("")), F.element_at(F.split("doc_path", "/"), -1)))
    chunks = embed(chunk_words(named, "text", size, overlap), fn)
    return chunks.select(
        F.sha2(F.concat_ws("\x1f", "doc_path", F.col("pos").cast("string")), 256).alias("chunk_id"),
        "doc_path", "cultivo", "tipo_doc", "titulo", "texto", "embedding", created_at.alias("created_at"),
    )


def reingest(store: DataFrame, docs: DataFrame, created_at: Column, fn: EmbedFn | None = None) -> DataFrame:
    """The store with the chunks of these documents replaced."""
    return replace_by_key(store, ingest_documents(docs, created_at, fn), "doc_path")


# ---- search ---------------------------------------------------------------

def _score(distance: Column) -> Column:
    return F.round(F.lit(1.0) - distance, 4)


def cosine_topk(chunks: DataFrame, query: Column | Sequence[float], k: int = 3,
                filters: Mapping[str, str] | None = None, key: str = "chunk_id") -> DataFrame:
    """The k chunks nearest to one query vector with their rank `puesto`, nearest first.

    One scan; each task keeps k rows, so the sort never sees the whole table.
    `query` may be a scalar subquery that yields one vector.
    """
    vector = query if isinstance(query, Column) else F.lit([float(x) for x in query])
    for column, value in (filters or {}).items():
        chunks = chunks.filter(F.col(column) == value)
    held = chunks.withColumn("_query", vector)
    scored = held.withColumn("_distance", cosine_distance(F.col("embedding"), F.col("_query")))
    order = F.col("_distance").asc_nulls_last(), F.col(key)
    best = scored.drop("embedding", "_query").orderBy(*order).limit(k)
    ranked = best.withColumn("puesto", F.row_number().over(W.orderBy(*order)))  # k rows
    return ranked.withColumn("score", _score(F.col("_distance"))).drop("_distance")


# Queries compared at once, the most that travel to every task; products of a batch within this of the k-th are scored exactly.
QUERY_BLOCK, NEARLY = 2048, 1e-9


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and vectors of the rows that have `dim` finite components and a length."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return at[good], x[good]


def _nearest(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of q and their cosine: for each q its k nearest, and what may tie with them."""
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
    products = x @ q.T
    last = max(0, len(x) - k)
    i, j = np.nonzero(products >= np.partition(products, last, axis=0)[last] - NEARLY)
    return i, j, (x[i] * q[j]).sum(axis=1)  # the same for equal vectors, wherever they stand


def cosine_topk_many(chunks: DataFrame, queries: DataFrame, k: int = 3, filters: Sequence[str] = ("cultivo", "tipo_doc"),
                     key: str = "chunk_id") -> DataFrame:
    """The k nearest chunks of every query with rank `puesto`: all chunk columns but the vector, `query_id`, `score`.

    `queries` brings query_id, vector and the `filters` columns: the value that a
    hit must have, or null for any. Queries travel in blocks of QUERY_BLOCK;
    each task multiplies its chunks with a block and keeps k rows per query, so no
    pair of chunk and query is ever a row. Where a chunk or a query has no direction
    (null, zero, null or non-finite components, another dimension) the score is
    null and comes last. Ties go to the smaller key.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *filters)
    blocks = -(-asked.count() // QUERY_BLOCK) or 1
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [_topk_of_block(chunks, asked.filter(part == i).collect(), asked, k, filters, key) for i in range(blocks)]
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    nearest = W.partitionBy("query_id").orderBy(F.col("_cosine").desc_nulls_last(), F.col(key))
    best = all_found.withColumn("puesto", F.row_number().over(nearest)).filter(F.col("puesto") <= k)
    return best.withColumn("score", F.round("_cosine", 4)).drop("_cosine")


def _topk_of_block(chunks: DataFrame, rows: Sequence[T.Row], asked: DataFrame, k: int, filters: Sequence[str], key: str) -> DataFrame:
    """k rows per query and task, with their cosine."""
    groups: dict[tuple, list[tuple]] = {}  # queries of one dimension, 0 without direction, with the same filter values
    for r in rows:
        v = r["vector"]
        good = bool(v) and None not in v and np.isfinite(v).all() and any(v)
        groups.setdefault((len(v) if good else 0, *[r[f] for f in filters]), []).append((r["query_id"], np.array(v if good else [])))
    names = [c for c in chunks.columns if c != "embedding"]
    columns = chunks.select(*names, F.col("embedding").cast("array<double>").alias("embedding"))
    id_field = asked.schema["query_id"]
    schema = T.StructType([*[chunks.schema[c] for c in names], id_field, T.StructField("_cosine", T.DoubleType())])
    arrow_id = to_arrow_type(id_field.dataType)

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by([("query_id", "ascending"), ("_cosine", "descending"), (key, "ascending")])
        codes = table.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        rank = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        return table.filter(pa.array(rank < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for (dim, *wanted), members in groups.items():
                fits = np.ones(len(batch), bool)
                for name, value in zip(filters, wanted, strict=True):
                    if value is not None:
                        fits &= pc.fill_null(pc.equal(batch.column(name), value), False).to_numpy(zero_copy_only=False)
                at, x = _matrix(batch.column("embedding"), dim) if dim else (np.empty(0, np.int64), np.empty((0, 0)))
                at, x = at[fits[at]], x[fits[at]]
                fits[at] = False
                # Of those without a direction the k smallest keys come after all others.
                rest = np.flatnonzero(fits)
                rest = rest[pc.sort_indices(batch.column(key).take(pa.array(rest))).to_numpy()[:k]]
                i, j, exact = _nearest(x, np.stack([v for _, v in members]), k) if len(at) else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
                take = np.concatenate((at[i], np.tile(rest, len(members))))
                who = np.concatenate((j, np.repeat(np.arange(len(members)), len(rest))))
                scores = np.concatenate((exact, np.full(len(take) - len(exact), np.nan)))
                rows_ = pa.Table.from_batches([batch.select(names)]).take(pa.array(take))
                ids = pa.array([members[m][0] for m in who.tolist()], arrow_id)
                rows_ = best(rows_.append_column("query_id", ids).append_column("_cosine", pa.array(scores, from_pandas=True)))
                held = rows_ if held is None else best(pa.concat_tables([held, rows_]))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return columns.mapInArrow(run, schema)


def cosine_topk_by_crop(chunks: DataFrame, queries: DataFrame, k: int = 3, key: str = "chunk_id") -> DataFrame:
    """The k nearest chunks of its crop for every query (query_id, cultivo, vector)."""
    return cosine_topk_many(chunks, queries.filter(F.col("cultivo").isNotNull()), k, ("cultivo",), key)


def semantic_query(chunks: DataFrame, text: str, k: int = 3, fn: EmbedFn | None = None,
                   filters: Mapping[str, str] | None = None) -> DataFrame:
    """Nearest chunks to a question."""
    if not text.strip():
        raise ValueError("the query is empty")
    vector = (fn or hashed_vectors())([text])[0]
    return cosine_topk(chunks, [float(x) for x in vector], k, filters)


def retrieved_context(hits: DataFrame, keys: Sequence[str] = (), rank: str = "puesto",
                      separator: str = "\n\n---\n\n") -> DataFrame:
    """Texts in rank order and their distinct sources (k rows per query at most)."""
    out = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(rank, "texto"))).alias("_texts"),
        F.array_sort(F.collect_set(F.coalesce("doc_path", "titulo"))).alias("fuentes"),
    )
    return out.select(*keys, F.array_join(F.col("_texts.texto"), separator).alias("resultado"), "fuentes")


# ---- inventory ------------------------------------------------------------

def document_inventory(chunks: DataFrame) -> DataFrame:
    """Chunks per document, most recently indexed first."""
    return (
        chunks.groupBy("doc_path", "cultivo", "tipo_doc")
        .agg(F.count(F.lit(1)).alias("chunks"), F.max("created_at").alias("indexed_at"))
        .orderBy(F.col("indexed_at").desc())
    )


def list_documents(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed documents beside the files in the store; either side may be missing."""
    return document_inventory(chunks).join(files, "doc_path", "full_outer")
