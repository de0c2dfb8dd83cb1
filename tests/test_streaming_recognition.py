import glob
import os
import threading
from collections import Counter
from datetime import datetime, timedelta

from leafmill.plans import recognition as plans
from leafmill.streaming import recognition

T0 = datetime(2024, 1, 1)


def ask_for(spark, folder, keys, minute=0):
    rows = [(k, k.encode(), T0 + timedelta(minutes=minute)) for k in keys]
    spark.createDataFrame(rows, recognition.REQUEST).coalesce(1).write.mode("append").parquet(folder)


def counting(log):
    """A recogniser that notes each call in a file; contents that begin with x fail."""

    def one(image):
        with open(log, "a") as f:
            f.write(image.decode() + "\n")
        if image.startswith(b"x"):
            raise ValueError("unreadable")
        return "read " + image.decode()

    return plans.each(one)


def calls(log):
    return Counter(open(log).read().split()) if os.path.exists(log) else Counter()


def test_two_streams_and_a_restart_recognise_each_content_once(spark, tmp_path):
    folder, cache, log = (str(tmp_path / n) for n in ("requests", "cache", "calls"))
    keys = [f"k{i}" for i in range(40)]

    def run(shard):
        asked = recognition.requests(spark, folder, files_per_batch=1)
        query = recognition.recognise(asked, cache, str(tmp_path / f"check-{shard}"), counting(log), shard=shard, shards=2)
        query.awaitTermination(120)
        assert query.exception() is None

    def run_both():
        threads = [threading.Thread(target=run, args=(s,)) for s in (0, 1)]
        [t.start() for t in threads]
        [t.join() for t in threads]

    ask_for(spark, folder, keys[:25] + keys[:5] + ["x1"])
    ask_for(spark, folder, keys[10:30], minute=1)
    run_both()
    ask_for(spark, folder, keys[20:], minute=2)  # after a restart, partly known
    ask_for(spark, folder, keys[:3], minute=300)  # long after the state forgot them
    run_both()
    assert calls(log) == Counter(keys + ["x1"])
    found = [tuple(r) for r in recognition.cached(spark, cache).collect()]
    assert sorted(found) == sorted((k, f"read {k}") for k in keys)
    assert [tuple(r) for r in recognition.failures(spark, cache).collect()] == [("x1", "ValueError: unreadable")]
    ask_for(spark, folder, ["x1"], minute=600)
    ask_for(spark, folder, ["k1"], minute=601)
    run_both()
    assert calls(log)["x1"] == 2 and calls(log)["k1"] == 1  # what failed may be tried again


def test_a_batch_that_was_written_is_not_asked_for_again(spark, tmp_path):
    folder, cache, log, check = (str(tmp_path / n) for n in ("requests", "cache", "calls", "check"))

    def run():
        query = recognition.recognise(recognition.requests(spark, folder), cache, check, counting(log))
        query.awaitTermination(120)
        assert query.exception() is None

    ask_for(spark, folder, ["a", "b"])
    run()
    for name in glob.glob(f"{check}/commits/*") + glob.glob(f"{check}/commits/.*crc"):
        os.rename(name, str(tmp_path / ("gone-" + os.path.basename(name))))  # it died before the stream knew
    run()
    assert calls(log) == Counter(["a", "b"]) and recognition.cached(spark, cache).count() == 2


def test_event_log_after_a_restart_is_that_of_an_unbroken_run(spark, tmp_path):
    source = str(tmp_path / "results")
    schema = "name string, error string, outputs bigint"
    for k in range(4):
        spark.createDataFrame([(f"f{k}{i}", "bad" if i == k else None, i) for i in range(3)], schema).coalesce(1).write.mode("append").parquet(source)
        os.utime(max(glob.glob(f"{source}/part-*"), key=os.path.getmtime), (1_700_000_000 + k, 1_700_000_000 + k))

    def run(name):
        results = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = recognition.report(results, str(tmp_path / name), str(tmp_path / f"check-{name}"))
        query.awaitTermination(120)
        assert query.exception() is None

    def log(name):
        return {n: sorted(r.value for r in spark.read.text(f"{tmp_path}/{name}/events/batch={n}").collect()) for n in range(4)}

    run("whole")
    run("broken")
    for last in ("3", "2"):
        for name in glob.glob(f"{tmp_path}/check-broken/commits/{last}") + glob.glob(f"{tmp_path}/check-broken/commits/.{last}.crc"):
            os.rename(name, str(tmp_path / ("gone" + os.path.basename(name))))
        run("broken")
    assert log("broken") == log("whole")
    assert '"data":{"total":12,"succeeded":9,"outputs":' in "".join(log("whole")[3])
