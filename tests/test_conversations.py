import pytest
from pyspark.sql import functions as F

from parlatrace.operators import conversations, queue, vectors
from parlatrace.streaming import live

PAYLOADS = "payload_id bigint, transcript_html string, started_at string, audio_duration_seconds int, source_tool string"


def test_chunks_and_their_conversation(spark, rows, tmp_path):
    texts = [(1, "abcdefghij" * 3, "2025-01-02", 5, "a"), (2, "", "2025-01-03", 0, None), (3, None, None, None, None), (None, "x", None, None, None), (1, "abcdefghij" * 3, "2025-01-02", 5, "a")]
    df = spark.createDataFrame(texts, PAYLOADS).withColumn("chunk_index", F.lit("clash"))
    whole = conversations.conversations(df, "transcript_html")
    assert rows(whole, "conversation_id") == [(1,), (2,), (3,)]
    pieces = conversations.chunks(whole, "conversation_id", "transcript", 12, 2)
    got = rows(pieces)
    assert [(k, i) for k, i, _ in got] == [(1, 0), (1, 1), (1, 2)] and got[0][2][-2:] == got[1][2][:2]
    assert got[0][2] + "".join(x[2][2:] for x in got[1:]) == "abcdefghij" * 3
    assert rows(conversations.with_conversation(pieces, whole), "conversation_id", "chunk_index", "source_tool") == [(1, i, "a") for i in range(3)]
    assert [r.conversation_id for r in conversations.latest_first(whole).collect()] == [2, 1, 3]
    for _ in range(2):
        conversations.store(whole, pieces, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "conversation_chunks")).count() == 3
    assert conversations.chunks(whole.limit(0), "conversation_id", "transcript").count() == 0


def test_appending_to_the_queue(spark, rows, monkeypatch):
    from parlatrace.operators import sequence

    monkeypatch.setattr(sequence, "SHARD_ROWS", 2)
    jobs = spark.createDataFrame([(1, 4, "waiting", "/a"), (2, 7, "error", "/b"), (3, 9, None, "/c"), (4, 2, "finished", None)], "job_id bigint, ordinal int, status string, transcript_file string")
    new = spark.createDataFrame([(20 + i, i * 3, p, i) for i, p in enumerate(["/a", "/b", "/d", "/e", "/c", "/f", "/g"])], "job_id bigint, ordinal int, transcript_file string, extra int")
    out = rows(queue.appended(jobs, new.drop("extra")).where("job_id >= 20"), "job_id", "ordinal", "status")
    assert out == [(21, 10, "waiting"), (22, 11, "waiting"), (23, 12, "waiting"), (25, 13, "waiting"), (26, 14, "waiting")]
    assert queue.appended(jobs, new.drop("extra").limit(0)).count() == 4
    assert rows(queue.appended(jobs.limit(0), new.drop("extra")), "ordinal") == [(i,) for i in range(7)]


def test_auto_save(spark, rows, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    query = live.auto_saved(stream, lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), at_end=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


@pytest.mark.parametrize("dims", [1, 2])
def test_both_ways_of_nearest_vectors_agree(spark, rows, dims):
    import random

    rng = random.Random(4)
    data = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4 + i % dims)]) for i in range(300)] + [(900, None), (901, []), (902, [0.0] * 4)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    sent, joined = (rows(vectors.nearest(df, df.where("vec_id % 7 = 0"), 5, sent_bytes=b), "query_id", "vec_id", "rank") for b in (10**6, 0))
    assert sent == joined and len(sent) == 5 * sum(any(v) for i, v in data[:300] if i % 7 == 0)
