"""Progress rows of a run of two batches, of one that fails, and what a late follower gets."""

import os
import time

import pytest

from kgspark.streaming import progress as P


def test_phases_and_counts_of_two_runs(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 3 + k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        os.utime(next(p for p in (tmp_path / f"in/{k}").iterdir() if p.name.startswith("part")), (1000 + k, 1000 + k))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "progress")
    log = P.ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        start = lambda f, name: stream.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        good = start(lambda df, n: df.collect() and None, "a")
        good.awaitTermination()

        def breaks(df, n):
            df.collect()
            if n == 1:
                raise RuntimeError("no room left")

        bad = start(breaks, "b")
        with pytest.raises(Exception, match="no room left"):
            bad.awaitTermination()
        end = time.time() + 60
        while log.last and time.time() < end:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    told = [(r["phase"], r["batch"], r["rows"]) for r in P.events(spark, path, str(good.runId)).orderBy("at").collect()]
    assert told[0] == ("started", None, None) and told[-1] == ("finished", None, None)
    assert [x for x in told if x[0] == "batch" and x[2]] == [("batch", 0, 3), ("batch", 1, 4)]
    now = {r["run"]: r for r in P.state(spark, path).collect()}
    assert (now[str(good.runId)]["phase"], now[str(good.runId)]["rows"]) == ("finished", 7)
    assert now[str(bad.runId)]["phase"] == "failed" and now[str(bad.runId)]["rows"] == 3 and "no room left" in now[str(bad.runId)]["error"]
    last = now[str(good.runId)]["at"]
    assert [r["phase"] for r in P.events(spark, path, str(good.runId), last - 1).collect()] == ["finished"]
