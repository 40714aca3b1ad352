"""Chunking and top-k similarity retrieval (per-instance vector index as a join).

``topk_similar`` is an equi-join of query vectors and chunk vectors on the instance key, an exact
squared-L2 distance computed with array higher-order functions (JVM side), and
``row_number() <= k`` per query.  Catalyst turns the filtered ranking into a ``WindowGroupLimit``
that keeps only ``k`` rows per query in every map task before the shuffle, so the shuffle carries
``k`` rows per (query, task) however large one instance's index is.  The query side is small (a few
queries per instance); the broadcast decision is left to adaptive execution, which broadcasts it
only when its measured size is under the threshold and uses a shuffled join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, spread

BATCH_CHARS = 1 << 22        # characters of chunks that leave a task at once
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
TOP_K = 50


def sq_l2(a: Column, b: Column) -> Column:
    """Squared euclidean distance of two equal-length numeric arrays, in DOUBLE."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"),
                                  lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sound_vector(v: Column) -> Column:
    """Whether a vector can be compared: not null, not empty, every component a finite number."""
    finite = F.forall(v.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(v) > 0), F.lit(False))


def topk_similar(chunks: DataFrame, queries: DataFrame, key_cols: list[str], chunk_id: str = "chunk_id",
                 query_id: str = "query_id", vec: str = "embedding", k: int = TOP_K) -> DataFrame:
    """Per query the ``k`` nearest chunks of the same instance (exact, ties broken by chunk id).

    Vectors that can't be compared (``sound_vector``) and pairs of different length are left out before
    the ranking, so they never push a real hit out.  Null instances pair with nothing.  Returns
    ``key_cols + [query_id, chunk_id, dist, rank]`` plus the remaining chunk columns.
    """
    q = queries.filter(sound_vector(F.col(vec))).select(*key_cols, query_id, F.col(vec).alias("_qvec"),
                                                        F.size(vec).alias("_dim"))
    c = chunks.filter(sound_vector(F.col(vec))).withColumn("_dim", F.size(vec))
    pairs = c.join(q, [*key_cols, "_dim"]).withColumn("dist", sq_l2(F.col(vec), F.col("_qvec"))).drop("_qvec", "_dim", vec)
    # Instances number their queries on their own, so a query is known by instance and id.
    w = Window.partitionBy(*key_cols, query_id).orderBy("dist", chunk_id)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _projected(df: DataFrame, vec: str, n: int, seed: int) -> DataFrame:
    """``df`` with ``_p``: the vector's products with ``n`` random unit vectors, the same for each dimension anywhere."""
    @F.pandas_udf("array<double>")
    def project(vectors):
        import numpy as np
        import pandas as pd

        ways, out = {}, [None] * len(vectors)
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(i)
        for dim, rows in by_dim.items():
            ways[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, n))
            ways[dim] /= np.linalg.norm(ways[dim], axis=0)
            x = np.stack([vectors.iloc[i] for i in rows]).astype(np.float64)
            for i, p in zip(rows, x @ ways[dim]):
                out[i] = p
        return pd.Series(out)

    return df.withColumn("_p", project(vec))


def topk_candidates(chunks: DataFrame, queries: DataFrame, key_cols: list[str], chunk_id: str = "chunk_id",
                    query_id: str = "query_id", vec: str = "embedding", k: int = TOP_K, tables: int = 6, hashes: int = 2,
                    width: float = 0.5, seed: int = 17, complete: bool = True) -> DataFrame:
    """``topk_similar`` through an index of p-stable hashes, for instances with very many chunks.

    Index: ``tables`` tables, each keyed by ``hashes`` random projections cut into buckets of ``width`` standard deviations.
    A query meets the chunks of its buckets; these candidates are ranked by exact distance.  With ``complete`` the
    result is then made exact: a chunk nearer than the k-th candidate must lie within that distance of the
    query on *every* projection, so the buckets of one projection in that range are joined, the others
    reject, and what is left is ranked again; a query with fewer than ``k`` candidates is compared with its whole
    instance.  Without, a hit may be missing; ``hit_recall`` measures how many are.  Columns, unsound vectors and ties as in
    ``topk_similar``.
    """
    ensure_checkpoint_dir(chunks.sparkSession)
    n = tables * hashes
    c = _projected(chunks.filter(sound_vector(F.col(vec))), vec, n, seed).withColumn("_dim", F.size(vec))
    q = _projected(queries.filter(sound_vector(F.col(vec))), vec, n, seed).select(
        *key_cols, query_id, F.col(vec).alias("_qvec"), F.size(vec).alias("_dim"), F.col("_p").alias("_qp"))
    # Projected once: both are joined twice.
    c, q = c.checkpoint(), q.checkpoint()
    spread = c.agg(F.stddev_pop(F.col("_p")[0])).first()[0]
    w = width * spread if spread else 1.0

    def bucket(x: Column) -> Column:
        return F.floor(x / F.lit(w))

    def table_keys(p: str) -> Column:
        return F.array(*[F.xxhash64(*[bucket(F.col(p)[t * hashes + j]) for j in range(hashes)]) for t in range(tables)])

    keyed_c = c.withColumn("_h", table_keys("_p")).select("*", F.posexplode("_h").alias("_t", "_k"))
    keyed_q = q.withColumn("_qh", table_keys("_qp")).select("*", F.posexplode("_qh").alias("_t", "_k"))
    # A pair that meets in several tables counts in the first of them.
    first = F.array_position(F.zip_with("_h", "_qh", lambda a, b: a == b), True) - 1
    at = [*key_cols, "_dim"]
    mine = Window.partitionBy(*key_cols, query_id).orderBy("dist", chunk_id)
    found = (keyed_c.join(keyed_q, [*at, "_t", "_k"]).filter(F.col("_t") == first)
             .withColumn("dist", sq_l2(F.col(vec), F.col("_qvec"))).withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k))
    names = [x for x in chunks.columns if x != vec]
    columns = [*names, query_id, "dist", "rank"]
    if not complete:
        return found.select(*columns)
    bound = found.groupBy(*key_cols, query_id).agg(F.max("dist").alias("_far"), F.count(F.lit(1)).alias("_n"))
    asked = q.join(bound, [*key_cols, query_id], "left")
    # A hair wider than the distance, for the rounding of products.
    asked = asked.withColumn("_r", F.when(F.col("_n") >= k, F.sqrt("_far") * (1 + 1e-9) + 1e-9)).drop("_far", "_n").checkpoint()
    near = F.sequence(bucket(F.col("_qp")[0] - F.col("_r")), bucket(F.col("_qp")[0] + F.col("_r")))
    within = F.forall(F.zip_with("_p", "_qp", lambda a, b: F.abs(a - b)), lambda x: x <= F.col("_r"))
    some = (c.withColumn("_b", bucket(F.col("_p")[0]))
            .join(asked.filter("_r is not null").withColumn("_b", F.explode(near)), [*at, "_b"]).filter(within).drop("_b"))
    every = c.join(asked.filter("_r is null"), at)
    pairs = some.unionByName(every).withColumn("dist", sq_l2(F.col(vec), F.col("_qvec")))
    return pairs.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k).select(*columns)


def hit_recall(hits: DataFrame, exact: DataFrame, key_cols: list[str], chunk_id: str = "chunk_id", query_id: str = "query_id") -> float:
    """Share of the exact hits that ``hits`` holds (1.0 when there are none)."""
    cols = [*key_cols, query_id, chunk_id]
    got = exact.select(*cols).join(hits.select(*cols, F.lit(1).alias("_hit")), cols, "left")
    found, total = got.agg(F.count("_hit"), F.count(F.lit(1))).first()
    return found / total if total else 1.0


def with_text_hash(texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with ``text_hash``, the part of a text's identity that changes when it does."""
    return texts.withColumn("text_hash", F.sha2(F.col(text_col).cast("binary"), 256))


def attach_vectors(texts: DataFrame, vectors: DataFrame, id_cols: list[str], vec: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tie vectors that were made elsewhere to the texts they were made from: ``(texts with their vector, texts
    without one, vectors without a text)``.  Both sides are known by ``id_cols`` and ``text_hash``, so a vector of
    an older text is never taken for the present one.  Of vectors that repeat an identity one is taken;
    null vectors and null identities count as missing."""
    ids = [*id_cols, "text_hash"]
    sound = vectors.filter(F.col(vec).isNotNull())
    one = sound.groupBy(*ids).agg(F.first(vec).alias(vec))
    return texts.join(one, ids), texts.join(sound, ids, "left_anti"), sound.join(texts, ids, "left_anti")


def retrieved_files(hits: DataFrame, key_cols: list[str], file_col: str = "rel_path") -> DataFrame:
    """Union of hits over all queries of an instance, one row per distinct file, best rank kept."""
    return hits.groupBy(*key_cols, file_col).agg(F.min("rank").alias("best_rank"))


def chunk_fixed(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed-stride character chunks: windows of ``size`` characters starting every
    ``size - overlap`` characters, the last window reaching the end of the text.
    Adds ``pos`` (0-based chunk number), ``start`` (1-based character offset) and ``chunk``."""
    stride = size - overlap
    n = F.char_length(F.col(text_col))
    last_start = F.greatest(n - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last_start, F.lit(stride))
    return (docs.select("*", F.posexplode(starts).alias("pos", "_off"))
            .withColumn("start", F.col("_off") + 1)
            .withColumn("chunk", F.substring(F.col(text_col), F.col("start"), F.lit(size)))
            .drop("_off"))


# Where a chunk may end, best first; with none of them in reach it is cut between characters.
BREAKS = ("\n\n", "\n", " ")


def text_cuts(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[int]:
    """Ends of the chunks of ``text``.  A chunk begins ``overlap`` characters before the last cut and holds at most
    ``size`` characters; it ends behind the last paragraph break between the last cut and there, else the last line
    break, else the last blank, else at its full size.  What fits one chunk is one."""
    cuts, cut = [], 0
    while True:
        reach = max(0, cut - overlap) + size
        if reach >= len(text):
            return [*cuts, len(text)]
        behind = ((text.rfind(b, cut, reach), len(b)) for b in BREAKS)
        cut = next((at + n for at, n in behind if at >= 0), reach)
        cuts.append(cut)


def chunk_recursive(docs: DataFrame, id_cols: list[str], text_col: str = "text", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks that end at a paragraph, else a line, else a word, else a character (``text_cuts``); columns
    ``id_cols + [pos, chunk]``, ``pos`` counted from 0.  One pass over each text, whatever its length, inside
    the row.  Null and empty texts have no chunks."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    own = docs.select(*id_cols, F.col(text_col).alias("_text")).filter(F.col("_text") != "")
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("pos", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def split(batches):
        import pyarrow as pa

        for b in batches:
            of, pos, chunks, held = [], [], [], 0
            for i, text in enumerate(b.column("_text").to_pylist()):
                last = 0
                for n, cut in enumerate(text_cuts(text, size, overlap)):
                    of.append(i)
                    pos.append(n)
                    chunks.append(text[max(0, last - overlap):cut])
                    held, last = held + len(chunks[-1]), cut
                if held >= BATCH_CHARS or i == b.num_rows - 1:
                    keys = b.drop_columns(["_text"]).take(pa.array(of, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(pos, pa.int32()), pa.array(chunks, pa.string())], names=schema.names)
                    of, pos, chunks, held = [], [], [], 0

    return spread(own).mapInArrow(split, schema)
