import random
from collections import defaultdict

import pytest

from parlatrace.llm.packing import Container, best_fit, containers_of, fill, fill_report
from parlatrace.llm.tokens import VOCABULARY, encoding, text_class, token_count

SCHEMA = "doc_id bigint, source string, cluster bigint, n_tokens bigint"


def plain_best_fit(sizes, sources, clusters, capacity, most):
    """The same rule by looking at every bin."""
    bins = []  # residual, sources, clusters
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], sources[i], i)):
        fits = [b for b in bins if b[0] >= sizes[i] and (clusters[i] < 0 or clusters[i] not in b[2]) and (most is None or len(b[1] | {sources[i]}) <= most)]
        b = min(fits, key=lambda b: b[0]) if fits else None
        if b is None:
            bins.append(b := [capacity, set(), set()])
        b[0] -= sizes[i]
        b[1].add(sources[i])
        if clusters[i] >= 0:
            b[2].add(clusters[i])
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("most", [None, 1, 2])
def test_against_plain_search(seed, most):
    rng = random.Random(seed)
    n = 200
    sizes, sources = [rng.randint(1, 100) for _ in range(n)], [rng.randrange(4) for _ in range(n)]
    clusters = [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
    sizes = [20 + 7 * c if c >= 0 else s for s, c in zip(sizes, clusters, strict=True)]
    placed = best_fit(sizes, sources, clusters, 100, most)
    bins = defaultdict(list)
    for i, b in enumerate(placed):
        bins[b].append(i)
    for members in bins.values():
        assert sum(sizes[i] for i in members) <= 100
        own = [clusters[i] for i in members if clusters[i] >= 0]
        assert len(own) == len(set(own))
        assert most is None or len({sources[i] for i in members}) <= most
    best = plain_best_fit(sizes, sources, clusters, 100, most)
    assert abs(len(bins) - best) <= max(1, best // 20)  # ties between bins of one residual may be taken otherwise


def test_hot_cluster_is_quick():
    n = 12_000
    placed = best_fit([3] * n, [0] * n, [0] * n, 1000, 4)
    assert len(set(placed)) == n


def test_fill(spark, rows):
    items = [(1, "a", 5, 10), (2, "a", 5, 10), (3, None, None, 4), (4, "b", 7, 25), (5, "b", None, 0), (6, "b", None, None), (7, "c", 8, 20), (None, "a", 1, 3)]
    df = spark.createDataFrame(items, SCHEMA).selectExpr("*", "1 as bin", "2 as shard", "3 as full", "'x' as limit_id")
    out = fill(df, [Container(1, 10), Container(2, 1000)])
    got = rows(out, "limit_id", "doc_id", "piece_no", "start_token", "end_token")
    assert got == [(1, 1, 0, 0, 10), (1, 2, 0, 0, 10), (1, 3, 0, 0, 4), (1, 4, 0, 0, 10), (1, 4, 1, 10, 20), (1, 4, 2, 20, 25), (1, 7, 0, 0, 10), (1, 7, 1, 10, 20), (2, 1, 0, 0, 10), (2, 2, 0, 0, 10), (2, 3, 0, 0, 4), (2, 4, 0, 0, 25), (2, 7, 0, 0, 20)]
    where = {(r.limit_id, r.doc_id): r.container_id for r in out.collect()}
    assert where[2, 1] != where[2, 2]  # copies never share a container
    assert rows(fill_report(out), "limit_id", "least_containers", "tokens") == [(1, 7, 69), (2, 1, 69)]
    assert fill(df.limit(0), [Container(1, 10)]).count() == 0


def test_fill_spreads(spark):
    rng = random.Random(2)
    items = [(i, "hot" if i % 3 else f"s{i % 5}", 1 if i % 3 == 0 else i + 10, rng.randint(1, 900)) for i in range(3000)]
    out = fill(spark.createDataFrame(items, SCHEMA), [Container(1, 2048)], shard_items=500)
    assert out.count() == 3000 and out.selectExpr("sum(end_token - start_token)").first()[0] == sum(i[3] for i in items)
    assert out.groupBy("container_id").agg({"end_token": "sum"}).where("`sum(end_token)` > 2048").count() == 0


def test_limits(spark):
    table = spark.createDataFrame([(1, "container", 512, "tokens"), (2, "piece", 9, "chars"), (3, "container", None, "tokens")], "limit_id int, purpose string, capacity int, unit string")
    assert containers_of(table) == [Container(1, 512)]


@pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no vocabulary here")
def test_tokens(spark):
    texts = ["Hello world, it's 2025!", "", None, "ﬀ 日本語 <|endoftext|>", "x" * 200_000, "   \n\n a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counts = [r[0] for r in df.select(token_count(df.t)).collect()]
    assert counts[1:3] == [0, None] and all(encoding().decode(encoding().encode_ordinary(t)) == t for t in texts if t)
    assert counts[0] == len(encoding().encode_ordinary(texts[0])) and counts[4] > 1000
    tokenizers = pytest.importorskip("tokenizers")
    import os

    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert [len(x.ids) for x in t.encode_batch([x for x in texts if x], add_special_tokens=False)] == [c for c in counts if c]


def test_text_class(spark):
    df = spark.createDataFrame([("Café au lait!",), ("cafe  AU lait",), ("cafe",), (None,), ("",), ("...",)], "t string")
    got = [r[0] for r in df.select(text_class(df.t)).collect()]
    assert got[0] == got[1] != got[2] and got[3] is got[4] is got[5] is None  # wordless texts are no copies of each other
