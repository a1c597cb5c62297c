"""Filling containers of fixed capacity: best fit by residual, under conflicts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 20_000
MAX_SOURCES = 4


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, max_sources: int | None = MAX_SOURCES) -> list[int]:
    """The bin of each item. Items are between 1 and the capacity; sources are small numbers; clusters are numbers, -1 for items without copies.

    The largest items go first. Open bins are kept by what room they have left (a bit mask tells which residuals there are), each
    with bitmaps of its sources and of its clusters of copies. An item goes to the bin with the least sufficient room that is
    compatible: none of its own cluster inside, and no more than max_sources sources with it. The search goes on to the next
    residual until a compatible bin is found; only if there is none a new bin is opened.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], sources[i], i))
    rooms: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
    mask = 0
    bin_clusters: list[int] = []
    placed = [0] * len(sizes)
    waiting: list[tuple[int, int, int]] = []  # bins that took a member of the present run of copies: none of them can take another
    run = (-1, -1)

    def put(room: int, sources_in: int, b: int) -> None:
        nonlocal mask
        if room:
            rooms[room].setdefault(sources_in, []).append(b)
            mask |= 1 << room

    for i in order:
        size, bit, cluster = sizes[i], 1 << sources[i], clusters[i]
        if (size, cluster) != run or cluster < 0:
            for w in waiting:
                put(*w)
            waiting, run = [], (size, cluster)
        chosen, left = None, mask >> size
        while left and chosen is None:
            room = size + (left & -left).bit_length() - 1
            groups = rooms[room]
            for inside, bins in groups.items():
                if max_sources is not None and not inside & bit and inside.bit_count() >= max_sources:
                    continue
                k = len(bins) - 1
                if cluster >= 0:
                    while k >= 0 and bin_clusters[bins[k]] >> cluster & 1:
                        k -= 1
                if k >= 0:
                    chosen = (room, inside, bins.pop(k))
                    if not bins:
                        del groups[inside]
                        if not groups:
                            mask &= ~(1 << room)
                    break
            left &= left - 1
        if chosen is None:
            chosen = (capacity, 0, len(bin_clusters))
            bin_clusters.append(0)
        room, inside, b = chosen
        placed[i] = b
        if cluster >= 0:
            bin_clusters[b] |= 1 << cluster
            waiting.append((room - size, inside | bit, b))
        else:
            put(room - size, inside | bit, b)
    return placed


@dataclass(frozen=True)
class Container:
    limit_id: int
    capacity: int


def containers_of(size_limits: DataFrame, most: int = 1000) -> list[Container]:
    """The container capacities in tokens; more than `most` rows of settings end the query."""
    rows = size_limits.where("purpose = 'container' and unit = 'tokens' and capacity > 0").orderBy("limit_id").limit(most + 1).collect()
    assert len(rows) <= most, "too many limits"
    return [Container(r["limit_id"], r["capacity"]) for r in rows]


def fill(items: DataFrame, containers: list[Container], max_sources: int | None = MAX_SOURCES, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(limit_id, capacity, container_id, doc_id, piece_no, start_token, end_token): every item in a container, for each capacity.

    items: (doc_id, source, cluster, n_tokens), one row per item; cluster is a number copies share, source may be null (a source
    of its own). An item that exceeds the capacity is cut into full containers and a rest, which is packed like the others;
    positions count its tokens, end exclusive. Items without tokens (null or 0) have nothing to place and get no row.

    Items are spread over shards by a hash of their number, as many as keep a shard at about shard_items items, and each
    shard is packed on its own: a source or a cluster of copies that makes up a third of all items is spread like the rest.
    """
    rows = items.where("n_tokens > 0 and doc_id is not null")
    total = rows.count()
    shards = max(1, -(-total // shard_items))
    limits = F.explode(F.array(*[F.struct(F.lit(c.limit_id).alias("limit_id"), F.lit(c.capacity).alias("capacity")) for c in containers])).alias("limit")
    sized = rows.select("doc_id", "source", "cluster", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), limits).select("doc_id", "source", "cluster", "n_tokens", "shard", "limit.*")
    sized = sized.withColumn("full", F.floor((F.col("n_tokens") - 1) / F.col("capacity"))).withColumn("rest", (F.col("n_tokens") - F.col("full") * F.col("capacity")).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable").reset_index(drop=True)
        source = pd.factorize(frame["source"], use_na_sentinel=False)[0]
        cluster = frame["cluster"].fillna(0)
        copies = (cluster.groupby(cluster).transform("size") > 1) & frame["cluster"].notna()
        number = np.full(len(frame), -1, dtype=np.int64)
        number[copies.to_numpy()] = pd.factorize(cluster[copies])[0]
        bins = best_fit(frame["rest"].tolist(), source.tolist(), number.tolist(), int(frame["capacity"].iloc[0]), max_sources)
        return pd.DataFrame({"limit_id": frame["limit_id"], "capacity": frame["capacity"], "shard": frame["shard"], "bin": bins, "doc_id": frame["doc_id"], "full": frame["full"], "rest": frame["rest"]})

    packed = sized.groupBy("limit_id", "shard").applyInPandas(pack, "limit_id int, capacity int, shard bigint, bin bigint, doc_id bigint, full bigint, rest int")
    rest = packed.select(
        "limit_id", "capacity", F.concat_ws("-", F.col("limit_id").cast("string"), F.lit("s"), F.col("shard").cast("string"), F.col("bin").cast("string")).alias("container_id"), "doc_id", F.col("full").alias("piece_no"),
        (F.col("full") * F.col("capacity")).alias("start_token"), (F.col("full") * F.col("capacity") + F.col("rest")).alias("end_token"),
    )
    over = sized.where("full > 0").select("limit_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece_no"))
    whole = over.select(
        "limit_id", "capacity", F.concat_ws("-", F.col("limit_id").cast("string"), F.lit("d"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"), "doc_id", "piece_no",
        (F.col("piece_no") * F.col("capacity")).alias("start_token"), ((F.col("piece_no") + 1) * F.col("capacity")).alias("end_token"),
    )
    return rest.unionByName(whole)


def fill_report(filled: DataFrame) -> DataFrame:
    """(limit_id, capacity, containers, least_containers, tokens, filled): least is what the tokens alone would need."""
    per = filled.groupBy("limit_id", "capacity", "container_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("n"))
    return per.groupBy("limit_id", "capacity").agg(F.count("*").alias("containers"), F.ceil(F.sum("n") / F.col("capacity")).alias("least_containers"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count("*") * F.col("capacity"))).alias("filled"))
