import datetime as dt

import pytest

from lectern.streaming import flows, hosts

START = dt.datetime(2024, 1, 1)
SCHEMA = "host string, url string, ts timestamp, failed_attempt int"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def stores(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    hosts.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


BATCHES = [
    [("h", "a", at(0), None), ("h", "b", at(0), None), ("h", "c", at(1), None), ("g", "x", at(0), None)],
    [("h", "a", at(3), 1), ("g", "x", at(4), 3), ("h", "d", at(3), None)],
    [("z", "tick", at(60), None)],
    [("h", "e", at(61), None), ("h", "a", at(61), 2)],
    [("z", "tock", at(9000), None)],
    [("z", "tock", at(20000), None)],
    [("h", "f", at(20001), None)],
]


def write(spark, folder, batches, first=0):
    for i, rows in enumerate(batches, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"{i:03d}"))


def run(spark, folder, out, checkpoint, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    flows.run_to_end(hosts.scheduled(stream, gap=2.0, wait=4.0, **how), str(out), str(checkpoint))
    return sorted((r.host, r.url, r.attempt, r.due and (r.due - START).total_seconds(), r.gave_up) for r in spark.read.parquet(str(out)).collect())


def test_schedule_and_restart(spark, tmp_path, stores):
    """Spacing, waits that double and giving up; a stream stopped and started again after each batch gives the same schedule as one run."""
    write(spark, tmp_path / "in", BATCHES)
    whole = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    assert ("h", "a", 1, 0.0, False) in whole and ("h", "b", 1, 2.0, False) in whole and ("h", "c", 1, 4.0, False) in whole
    assert ("h", "d", 1, 6.0, False) in whole
    assert ("g", "x", 3, None, True) in whole
    assert ("h", "a", 2, 8.0, False) in whole  # failed at 3, its wait is over at 7, but d is asked at 6
    assert ("h", "a", 3, 69.0, False) in whole  # failed at 61, due eight seconds later
    assert ("h", "f", 1, 20001.0, False) in whole
    assert len(whole) == 13
    for i in range(0, len(BATCHES), 2):
        write(spark, tmp_path / "in2", BATCHES[i : i + 2], i)
        parts = run(spark, tmp_path / "in2", tmp_path / "out2", tmp_path / "c2")
    assert parts == whole


def test_initial_state(spark, tmp_path, stores):
    write(spark, tmp_path / "in", [[("h", "a", at(0), None), ("g", "b", at(0), None)]])
    known = spark.createDataFrame([("h", at(5))], "host string, last_due timestamp")
    got = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c", last_asked=known)
    assert got == [("g", "b", 1, 0.0, False), ("h", "a", 1, 7.0, False)]


def test_needs_its_state_store(spark, tmp_path):
    write(spark, tmp_path / "in", [[("h", "a", at(0), None)]])
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != hosts.PROVIDER:
        with pytest.raises(ValueError):
            hosts.scheduled(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
