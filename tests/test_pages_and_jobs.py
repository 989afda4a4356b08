"""Paragraphs by their look, and jobs that a client may leave."""

import threading
import time

from redactlake.operators import layout
from redactlake.streaming import jobs

ROW = "doc_id int, page int, row_no int, text string, x0 double, x1 double, size double, bold boolean, left_margin double, right_margin double"


def lines(spark, rows):
    shaped = [(1, 1, k, text, x0, x1, size, bold, 50.0, 550.0) for k, (text, x0, x1, size, bold) in enumerate(rows)]
    return [r.lines for r in layout.paragraphs(spark.createDataFrame(shaped, ROW)).orderBy("paragraph").collect()]


def test_paragraphs(spark):
    long = "a line that reaches the margin of the page and goes on to"
    assert lines(spark, [("A TITLE", 260.0, 340.0, 10.0, False), (long, 50.0, 545.0, 10.0, False), ("the next one.", 50.0, 150.0, 10.0, False), ("Another begins", 50.0, 160.0, 10.0, False), ("and goes on short", 50.0, 180.0, 10.0, False)]) == [
        ["A TITLE"], [long, "the next one."], ["Another begins", "and goes on short"],
    ]
    assert lines(spark, [("Bold head", 50.0, 545.0, 10.0, True), ("text", 50.0, 100.0, 10.0, False)]) == [["Bold head"], ["text"]]
    assert lines(spark, [(long + " it.", 50.0, 548.0, 10.0, False), ("Indented text", 70.0, 200.0, 10.0, False)]) == [[long + " it."], ["Indented text"]]
    assert lines(spark, [("a\tb", 50.0, 548.0, 10.0, False), ("c", 50.0, 60.0, 10.0, False)]) == [["a\tb"], ["c"]]


def test_cancel(spark):
    ended = []

    def work():
        with jobs.cancellable(spark, "client-1"):
            try:
                spark.range(4).repartition(4).rdd.map(lambda _: time.sleep(60)).count()
            except Exception as e:  # noqa: BLE001  what Spark raises for a cancelled job
                ended.append(e)

    from pyspark import InheritableThread

    thread = InheritableThread(target=work)
    began = time.time()
    thread.start()
    while thread.is_alive() and time.time() - began < 40:
        time.sleep(0.5)
        jobs.cancel(spark, "client-1")
    thread.join(1)
    assert ended and time.time() - began < 45 and threading.active_count() >= 1


def test_slots(spark):
    rows = [("k", n, at, 10) for n, at in enumerate([0, 1, 2, 30])] + [("other", 9, 2, 5)]
    got = {r.seq: (r.began, r.queued) for r in jobs.slots(spark.createDataFrame(rows, "key string, seq int, arrival long, micros long"), 2).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (10, True), 3: (30, False), 9: (2, False)}


def test_compounds_keep_their_hyphen(spark):
    lines = spark.createDataFrame([(1, 1, 1, ["un porte-", "feuille et un rendez-", "vous"]), (1, 1, 2, ["ce portefeuille, un rendez-vous, rendezvous"])], "doc_id int, page int, paragraph int, lines array<string>")
    got = {r.paragraph: r.text for r in layout.join_hyphens(lines, layout.vocabulary(lines)).collect()}
    assert got[1] == "un portefeuille et un rendez-vous"


def test_keepalive_stream(spark, tmp_path):
    spark.createDataFrame([("a", "read"), ("b", "done")], "key string, stage string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, stage string").parquet(str(tmp_path / "in"))
    query = jobs.keepalive_stream(source, 0.5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    out = lambda: spark.read.schema("key string, event string, n int").parquet(str(tmp_path / "out"))
    try:
        began = time.time()
        while time.time() - began < 60 and not ((tmp_path / "out" / "_spark_metadata").exists() and out().count() >= 2):
            time.sleep(1)
    finally:
        query.stop()
    got = [tuple(r) for r in out().orderBy("n").limit(2).collect()]
    assert got == [("a", "keepalive", 1), ("a", "keepalive", 2)]
