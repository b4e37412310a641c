import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waraq.operators.delivery import SeenLog, bit_is_set, keep_one, superfluous

PAGES = "delivery_id bigint, book_id int, page_id int, url_page_id int, sub_idx int, received_at timestamp, number string, code int, shard string, bits int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x", 2) for r in rows], PAGES)


def brute(rows):
    best = {}
    for d, b, p, u, s, at in rows:
        n = p if p is not None else u
        if n is None:
            continue
        rank = (at is None, at or 0, d is None, d or 0)
        best[b, n, s] = min(best.get((b, n, s), (rank, d)), (rank, d), key=lambda x: x[0])
    kept = {d for _, d in best.values()}
    return sorted({r[0] for r in rows if (r[2] is not None or r[3] is not None) and r[0] is not None} - kept)


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_equals_brute_force_for_any_number_of_rounds(spark, rounds):
    rng = random.Random(rounds)
    at = lambda: rng.choice([None, *[datetime(2024, 1, 1) + timedelta(hours=rng.randrange(40)) for _ in range(9)]])
    rows = [(k, rng.choice([1, 1, 2, None]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 4]), rng.choice([0, 1, None]), at()) for k in range(400)]
    assert sorted(r.delivery_id for r in superfluous(table(spark, rows), rounds).collect()) == brute(rows)


def test_ties_and_repeated_rows(spark):
    t = datetime(2024, 1, 1)
    rows = [(7, 1, 1, 1, 0, t), (3, 1, 1, 1, 0, t), (3, 1, 1, 1, 0, t), (9, 1, 1, 1, 0, t), (9, 1, 1, 1, 0, t), (None, 1, 1, 1, 0, t)]
    assert sorted(r.delivery_id for r in superfluous(table(spark, rows)).collect()) == [7, 9]


def test_empty(spark):
    assert superfluous(table(spark, [])).collect() == []
    assert keep_one(table(spark, [])).collect() == []


def test_hot_identifier(spark):
    t = datetime(2024, 1, 1)
    rows = [(k, 1, 1, 1, 0, t + timedelta(seconds=k % 77)) for k in range(3000)] + [(k, 2, k, k, 0, t) for k in range(3000, 3100)]
    assert len(superfluous(table(spark, rows)).collect()) == 2999


def test_log_remembers_across_batches_and_codes_are_dense(spark):
    log = SeenLog(spark, shards=2)
    batch = lambda ids: spark.createDataFrame([(i, 10 * i) for i in ids], "id int, arrival bigint")
    assert sorted(r.id for r in log.ingest(batch([1, 2, 3, 3]), ["id"], [], "arrival").collect()) == [1, 2, 3]
    assert sorted(r.id for r in log.ingest(batch([2, 3, 4, 5]), ["id"], [], "arrival").collect()) == [4, 5]
    assert log.ingest(batch([]), ["id"], [], "arrival").collect() == []
    assert log.ingest(batch([1, 5]), ["id"], [], "arrival").collect() == []
    assert log.version() == 4
    log.compact()
    assert log.version() == 5 and log.ingest(batch([2, 4, 6]), ["id"], [], "arrival").collect()[0].id == 6
    assert log.ingest(batch([6, 1]), ["id"], [], "arrival").collect() == []
    codes = sorted((r.shard, r.code) for r in log.dictionary().collect())
    assert len(set(codes)) == 6 and all(code == k - [s for s, _ in codes].index(shard) for k, (shard, code) in enumerate(codes))
    assert sum(r.n for r in log.bitmaps().select(F.bitmap_count("bits").alias("n")).collect()) == 6


def test_uncommitted_batch_changes_nothing(spark):
    log = SeenLog(spark, shards=2)
    bad = spark.createDataFrame([(1, 1)], "id int, arrival bigint").select(F.raise_error(F.lit("lost")).cast("int").alias("id"), "arrival")
    with pytest.raises(Exception):
        log.ingest(bad, ["id"], [], "arrival")
    assert log.version() == 0


def test_bit_is_set(spark):
    df = spark.range(100).where("id % 3 = 0").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("id") + 1)).alias("b"))
    got = df.crossJoin(spark.range(120).toDF("i")).where(bit_is_set(F.col("b"), F.bitmap_bit_position(F.col("i") + 1))).select("i").collect()
    assert sorted(r.i for r in got) == list(range(0, 100, 3))


def batch_of(spark, ids):
    return spark.createDataFrame([(i, 10 * i) for i in ids], "id int, arrival bigint")


def test_shards_are_stored_and_a_mismatch_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    SeenLog(spark, path, shards=2).ingest(batch_of(spark, range(20)), ["id"], [], "arrival")
    assert SeenLog(spark, path).ingest(batch_of(spark, range(25)), ["id"], [], "arrival").count() == 5
    with pytest.raises(ValueError):
        SeenLog(spark, path, shards=3)
    with pytest.raises(ValueError):
        SeenLog(spark, path).ingest(batch_of(spark, [1]).withColumnRenamed("id", "other"), ["other"], [], "arrival")
    assert SeenLog(spark, path, shards=2).version() == 2


def test_of_two_writers_one_commits(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    slow, fast = SeenLog(spark, path, shards=2), SeenLog(spark, path, shards=2)
    fast.ingest(batch_of(spark, [1]), ["id"], [], "arrival")
    commit = slow._commit

    def overtaken(*args):
        assert fast.ingest(batch_of(spark, [2, 3]), ["id"], [], "arrival").count() == 2
        commit(*args)

    slow._commit = overtaken
    with pytest.raises(RuntimeError):
        slow.ingest(batch_of(spark, [2, 4]), ["id"], [], "arrival")
    slow._commit = commit
    assert slow.version() == 2
    assert [r.id for r in slow.ingest(batch_of(spark, [2, 4]), ["id"], [], "arrival").collect()] == [4]


def test_a_file_is_published_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from waraq.shared import publish, read_text

    path = f"file://{tmp_path}/a/b"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: publish(spark, path, f"writer {k}"), range(16)))
    assert sum(won) == 1 and read_text(spark, path) == f"writer {won.index(True)}"
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["b"]


def test_a_log_needs_no_other_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("waraq.operators.delivery.fresh_path", None)
    monkeypatch.setattr("waraq.operators.delivery.COMPACT_AFTER", 2)
    log = SeenLog(spark, f"file://{tmp_path}/log", shards=2)
    for k in range(4):
        assert log.ingest(batch_of(spark, range(k, k + 2)), ["id"], [], "arrival").count() == (2 if k == 0 else 1)
    assert log.version() == 5 and len(log._versions()) == 2
    assert log.dictionary().count() == 5


def test_a_batch_moves_nothing_of_the_log(spark, tmp_path):
    log = SeenLog(spark, f"file://{tmp_path}/log", shards=4)
    log.ingest(batch_of(spark, range(50)), ["id"], [], "arrival")
    known = log._read(log._versions()[0], "dict").select(F.col("h").alias("_h"), "code").hint("merge")
    plan = batch_of(spark, range(9)).withColumn("h", F.xxhash64("id")).join(known, F.col("h") == F.col("_h"), "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
