"""The pairs of a stream are those of the table, also over restarts, repeated batches and timers."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from argloom.operators import preference
from argloom.streaming.pairs import STATE_STORE, solution_pairs, written_to

SCHEMA = "problem_id string, sol_pos long, is_valid boolean, note string"


@pytest.fixture
def stores(spark):
    own = STATE_STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}  # timers would keep such batches coming
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")
    for f in (folder / name).glob("part*"):
        shutil.move(f, folder / f"{name}.parquet")


def run(spark, source, out, state, n, wait=3600.0, sink=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*.parquet"))
    query = solution_pairs(stream, n, wait).writeStream.foreachBatch(sink or written_to(str(out))).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def pairs(spark, out):
    return sorted(map(tuple, spark.read.schema("problem_id string, chosen long, rejected long").parquet(f"{out}/batch=*").collect()), key=str)


def test_pairs_of_a_stream(spark, stores, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    rows = [(None if p == 3 else f"p{p}", s, None if (p * s) % 7 == 5 else (p + s) % 3 == 0, "x") for p in range(8) for s in range(6)]
    whole = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, preference.validity_pairs(whole.withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))).collect()), key=str)
    put(spark, source, rows[0::3], "a")
    put(spark, source, rows[1::3], "b")
    run(spark, source, out, state, 6)
    assert pairs(spark, out) == []  # no problem is complete
    failed = []

    def fails_once(batch, number):
        written_to(str(out))(batch, number)
        if not failed:
            failed.append(number)
            raise RuntimeError("after the batch was written")

    put(spark, source, rows[2::3], "c")
    with pytest.raises(Exception, match="after the batch was written"):
        run(spark, source, out, state, 6, sink=fails_once)
    run(spark, source, out, state, 6)  # from the checkpoint: the batch runs again
    assert pairs(spark, out) == want and len(want) > 3


def test_those_who_wait(spark, stores, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    put(spark, source, [("p", 2, True, ""), ("p", 1, False, ""), ("q", 1, True, "")], "a")
    run(spark, source, out, state, 5, wait=0.001)
    time.sleep(0.1)
    put(spark, source, [("r", 1, True, "")], "b")
    run(spark, source, out, state, 5, wait=0.001)
    assert pairs(spark, out) == [("p", 2, 1)]
