import datetime as dt
import json
import shutil
import sys

import pytest
from pyspark.sql import functions as F

from eralex.operators import references
from eralex.sources import providers, readers, sinks
from eralex.streaming import ingest as streaming

SEC = [{"statute": "IPC", "section_no": "1"}]


def test_json_scans(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps([{"ipc_section": "1", "bns_section": "2", "description": "é", "source": "x"}], indent=2, ensure_ascii=False))
    assert readers.json_votes(spark, str(tmp_path / "v*.json")).head().description == "é"
    (tmp_path / "j.json").write_text(json.dumps({"judgments": [{"judgment_id": "a", "sections_cited": SEC}, {"judgment_id": "b"}]}, indent=1))
    assert [(r.source_file, r.pos, r.judgment_id) for r in readers.json_envelope(spark, str(tmp_path / "j.json")).collect()] == [("j.json", 0, "a"), ("j.json", 1, "b")]


def test_html(spark, tmp_path):
    (tmp_path / "a.html").write_text("<table><tr><td>Other</td></tr></table><table><tr><th> Old Code, 1860 </th><th>New</th></tr><tr><td>1 A</td><td>2</td></tr><tr><td>odd</td></tr></table>")
    cells = readers.first_table_about(readers.html_cells(spark, str(tmp_path / "*.html")), "Old Code")
    assert sorted((r.left, r.right) for r in readers.cell_pairs(cells).collect()) == [("1 A", "2"), ("Old Code, 1860", "New")]


def test_lossy_and_index(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"ok \xff end")
    assert readers.lossy_text(spark, str(tmp_path / "x.txt")).head().text == "ok � end"
    (tmp_path / "b.pdf").write_bytes(b"x")
    ix = readers.file_index(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a.pdf", "b.pdf"), (2, "q.pdf", "r.pdf")], "k int, c1 string, c2 string")
    got = {r.k: r.path for r in readers.first_existing(rows, "k", ["c1", "c2"], ix).collect()}
    assert got[1].endswith("b.pdf") and got[2] is None


def test_bounded_extraction(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"hello")
    upper = readers.bounded([sys.executable, "-c", "import sys; print(sys.stdin.read().upper(), end='')"], 20)
    assert readers.documents_text(spark, str(tmp_path / "f.bin"), upper).head().text == "HELLO"
    slow = readers.bounded([sys.executable, "-c", "import time; time.sleep(30)"], 0.5)
    assert readers.documents_text(spark, str(tmp_path / "f.bin"), slow, 1).head().text is None


def test_partitions_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", 2020, "x"), ("b", 2021, "y")], "cnr string, year int, court string")
    df.write.partitionBy("year", "court").parquet(str(tmp_path / "p"))
    pruned = readers.partitioned_parquet(spark, str(tmp_path / "p")).where("year = 2021")
    assert [r.cnr for r in pruned.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()
    m = spark.createDataFrame([("c", "n, \"q\"", dt.date(2020, 1, 2), None, "x", "k", "l")], "cnr string, case_name string, date date, judge string, court string, s3_key string, local_path string")
    sinks.write_manifest(m, str(tmp_path / "m"))
    assert readers.csv_manifest(spark, str(tmp_path / "m")).collect() == m.collect()


def test_split_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, None), (3, False)], "i int, ok boolean")
    sinks.write_split(df, F.col("ok"), str(tmp_path / "k"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 1 and spark.read.parquet(str(tmp_path / "r")).count() == 2
    for _ in range(2):
        sinks.append_missing(df, "i", str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3


def test_providers(spark):
    providers.register_embedder("length", lambda: lambda texts: [[float(len(t)), 0.0] for t in texts])
    df = spark.createDataFrame([(1, "abc"), (2, None)], "i int, t string")
    assert {r.i: r.vec for r in providers.embed_with(df, "length", ["i"], "t").collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    assert providers.score_with(df, lambda: lambda a, b: [float(x == y) for x, y in zip(a, b)], ["i"], "t", "t").head().score == 1.0

    def busy():
        calls = []

        def model(t):
            calls.append(t)
            if len(calls) < 3:
                raise providers.Busy(0.01)
            return t.upper()

        return model

    assert providers.generate_with(df.where("i = 1"), busy, ["i"], "t").head().answer == "ABC"
    assert providers.generate_with(df.where("i = 1"), lambda: lambda t: (_ for _ in ()).throw(providers.Busy(0.0)), ["i"], "t", tries=2).head().answer is None


def test_fetching(spark):
    def make():
        tried = []

        def fetch(where):
            tried.append(where)
            if where == "slow" and tried.count("slow") < 3:
                raise providers.Busy(0.01)
            if where == "gone":
                raise FileNotFoundError(where)
            return where.encode()

        return fetch

    df = spark.createDataFrame([(1, "a"), (2, "gone"), (3, None), (4, "slow")], "i int, at string").coalesce(1)
    got = {r.i: (r.content and bytes(r.content), r.error) for r in providers.fetch_with(df, make, ["i"], "at", tries=3).collect()}
    assert got == {1: (b"a", None), 2: (None, "FileNotFoundError: gone"), 3: (None, "no address"), 4: (b"slow", None)}


def test_pages_and_progress(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"cover\f1. Text\n-----------\nfootnote\n2.\nmore\fend")
    done = spark.sparkContext.accumulator(0)
    got = readers.document_pages(spark, str(tmp_path / "*.bin"), lambda b: b.decode(), 1, done=done).collect()
    assert [r.text for r in got] == ["1. Text\n2.\nmore\nend"] and done.value == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [0.5, 1.0]), (2, None, [0.0, 1.0])], "i int, t string, vec array<double>")
    sinks.write_vectors(df, "i", "vec", str(tmp_path / "d"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "d")).columns == ["i", "t"] and spark.read.parquet(str(tmp_path / "v")).count() == 2
    sinks.write_split(df, F.lit(True), str(tmp_path / "k"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    for _ in range(2):
        sinks.write_review(df.select("i"), df.where("i = 2"), str(tmp_path / "t"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4 and spark.read.parquet(str(tmp_path / "r")).count() == 1
    assert sinks.report(df.select("i", "t", F.col("vec")[0].alias("x")).orderBy("i")) == "i  t  x\n1  a  0.5000\n2  -  0.0000"


def test_streaming_ingest(spark, tmp_path):
    schema = "judgment_id string, case_name string, court string, date date, bench array<string>, sections_cited array<struct<statute:string,section_no:string>>, text string, disposal string, ord int"
    row = lambda i, o, text="t": (i, "n", "c", dt.date(2020, 1, 1), ["x"], SEC, text, "allowed", o)
    src, clean, bad, cp = (str(tmp_path / x) for x in ("src", "clean", "bad", "cp"))
    run = lambda: streaming.ingest_stream(spark, src, spark.createDataFrame([], schema).schema, clean, bad, cp, ["ord"]).awaitTermination()
    spark.createDataFrame([row("a", 1), row("a", 2), row("b", 3, " ")], schema).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([row("a", 4), row("c", 5)], schema).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.judgment_id, r.ord) for r in spark.read.parquet(clean).collect()) == [("a", 1), ("c", 5)]
    lost = {(r.judgment_id, r.ord): r.problems[0] for r in spark.read.parquet(bad).collect()}
    assert lost == {("a", 2): "duplicate judgment_id", ("a", 4): "duplicate judgment_id", ("b", 3): "blank text"}  # every row is on one side


def test_streaming_references(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint, a string, at timestamp").schema
    src = str(tmp_path / "src")
    rec = spark.createDataFrame([], "jid string, s timestamp, u timestamp").schema
    recs = str(tmp_path / "recs")
    run = lambda: streaming.reference_stream(spark, src, schema, str(tmp_path / "st"), str(tmp_path / "cp"), ["a"], "at", (recs, rec, "jid", "s", "u")).awaitTermination()
    at = dt.datetime(2020, 1, 1)
    spark.createDataFrame([("k", at, None)], rec).coalesce(1).write.parquet(recs)
    spark.createDataFrame([(1, "k", at), (2, "k", at)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("q", at, at + dt.timedelta(1))], rec).coalesce(1).write.mode("append").parquet(recs)
    spark.createDataFrame([(3, "k", at), (4, "q", at)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    state = spark.read.parquet(str(tmp_path / "st" / "batch=1"))
    assert {(r.key, r.existence, r.refs) for r in state.collect()} == {("K", 1, 3), ("Q", 0, 1)}
    assert [r.key for r in references.current_orphans(state).collect()] == ["Q"]


def test_lost_state_fails(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint, a string, at timestamp").schema
    src, st = str(tmp_path / "src"), tmp_path / "st"
    run = lambda: streaming.reference_stream(spark, src, schema, str(st), str(tmp_path / "cp"), ["a"], "at").awaitTermination()
    row = lambda i: spark.createDataFrame([(i, "k", dt.datetime(2020, 1, 1))], schema).write.mode("append").parquet(src)
    row(1)
    run()
    shutil.rmtree(st)
    row(2)
    with pytest.raises(Exception, match="missing"):
        run()


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "e")
    at = dt.datetime(2020, 1, 1, 10)
    spark.createDataFrame([(at + dt.timedelta(minutes=10 * i), "a" if i % 2 else "b") for i in range(12)], "ts timestamp, kind string").write.parquet(src)
    q = streaming.windowed_counts(spark.readStream.schema("ts timestamp, kind string").parquet(src), "ts", "kind").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) s from wc").head().s == 12
