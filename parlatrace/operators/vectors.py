"""Exact nearest vectors by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 256
SALTS = 64
#: Queries of up to so many bytes go to the tasks as they are; more meet the vectors in a join.
SENT_BYTES = 32_000_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The k vectors nearest to each query by cosine: (query_id, vec_id, similarity, rank), ties by the lower vec_id; a vector isn't its own neighbour.

    The stated queries are held against all rows in blocks of at most 256, as a matrix product, and each partition of the vectors keeps k rows per
    query before anything is shuffled. Queries whose size is checked to be at most sent_bytes are sent to the tasks once, so that no vector is
    shuffled at all; others meet the vectors in a join, block by block. Null, empty and all-zero
    vectors take no part; vectors of another length than the query's don't either.
    """
    import numpy as np
    import pandas as pd

    asked = queries.where("embedding is not null and size(embedding) > 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = vectors.where("embedding is not null and size(embedding) > 0").select("vec_id", "embedding", F.size("embedding").alias("dim"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def best(ids, v, query_ids, q) -> pd.DataFrame:
        """Of each query the k most similar rows and those that equal the last of them."""
        nq, nv = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            sim = (q @ v.T) / nq[:, None] / nv[None, :]
        out = []
        for x, s in zip(query_ids, sim, strict=True):
            s = np.where(ids == x, np.nan, s)
            keep = np.flatnonzero(~np.isnan(s))
            if len(keep) > k:
                edge = np.partition(s[keep], -k)[-k]
                keep = keep[s[keep] >= edge - 1e-9]  # ranks go by nine digits
            out.append(pd.DataFrame({"query_id": x, "vec_id": ids[keep], "similarity": s[keep]}))
        return pd.concat(out, ignore_index=True)

    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("q")).alias("numbers")).first()
    if (size["numbers"] or 0) * 8 <= sent_bytes:
        sent: dict[int, tuple[list[int], list]] = {}
        for r in asked.orderBy("query_id").collect():
            ids, qs = sent.setdefault(len(r["q"]), ([], []))
            ids.append(r["query_id"])
            qs.append(r["q"])
        matrices = {dim: (ids, np.asarray(qs, dtype=np.float64)) for dim, (ids, qs) in sent.items()}

        def top(frames):
            for f in frames:
                for dim, part in f.groupby("dim", sort=False):
                    if dim in matrices:
                        ids, v = part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(np.float64)
                        query_ids, q = matrices[dim]
                        for i in range(0, len(query_ids), QUERY_BLOCK):
                            yield best(ids, v, query_ids[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK])

        near = rows.mapInPandas(top, schema)
    else:
        blocks = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-size["n"] // QUERY_BLOCK)))).alias("block"), F.size("q").alias("dim")).agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
        # a block goes to every salt, so that the rows of one length needn't go to one task
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))

        def top(frames):
            for f in frames:
                for _, part in f.groupby(["dim", "block"], sort=False):
                    qs = part["qs"].iloc[0]
                    yield best(part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(np.float64), [x["query_id"] for x in qs], np.stack([np.asarray(x["q"], dtype=np.float64) for x in qs]))

        near = salted.join(blocks, ["dim", "salt"]).mapInPandas(top, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
