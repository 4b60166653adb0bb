import json

from pyspark.sql import functions as F

from lodestone.operators.ranking import ranked, running_sum, shifted
from lodestone.operators.timestamps import normalise_timestamps
from lodestone.sources import readers, writers
from lodestone.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n \n\n three ")
    assert [r["abstract"] for r in readers.pasted_abstracts(spark, str(tmp_path / "a.txt")).orderBy("position").collect()] == ["one", "two", "three"]
    (tmp_path / "c.csv").write_text(" Name , Number \nx,3\ny,bad\nz,2.7\n")
    assert {tuple(r) for r in readers.term_counts(spark, str(tmp_path / "c.csv")).collect()} == {("x", 3), ("y", 0), ("z", 2)}
    (tmp_path / "m.txt").write_text('DOI,Materials\n10.1/x,"A, B"\nq.pdf: C, C\n\n')
    assert {tuple(r)[1:] for r in readers.material_lines(spark, str(tmp_path / "m.txt"), "m").collect()} == {("10.1/x", "A"), ("10.1/x", "B"), ("q.pdf", "C")}
    (tmp_path / "j.json").write_text(json.dumps({"a": 1}) + "\nbroken\n")
    assert sorted(r["a"] or 0 for r in readers.json_lines(spark, str(tmp_path / "j.json"), "a int").collect()) == [0, 1]
    (tmp_path / "g.csv").write_text("1,2\n3,x\n")
    assert {tuple(r) for r in readers.field_grid(spark, str(tmp_path / "g.csv")).collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, None)}
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    assert readers.binary_documents(spark, str(tmp_path)).first()["size_bytes"] == 4


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    writers.insert_or_ignore(rows(("a", 1), ("a", 1), (None, 9)), path, "k")
    writers.insert_or_ignore(rows(("a", 2), ("b", 3)), path, "k")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    part = str(tmp_path / "p")
    writers.replace_keys(rows(("a", 1), ("b", 2)), part, "k")
    writers.replace_keys(rows(("b", 5)), part, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(part).collect()} == {("a", 1), ("b", 5)}
    writers.export_csv(rows(("a", 1)).withColumn("x", F.array(F.lit(1))), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["x"] == "[1]"
    writers.export_graph(rows(("a", 1)), rows(("e", 2)).withColumn("n", F.map_from_arrays(F.array(F.lit("q")), F.array(F.lit(1)))), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "links")).columns == ["k", "v"]
    for style in ("markdown", "html", "latex", "plain"):
        assert "a" in writers.comparison_table(rows(("a", None)), style)


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "s")
    e = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02}:00", f"c{(h * 7 + m) % 5}") for h in range(3) for m in range(0, 60, 7)], "ts string, checksum string").withColumn("ts", F.to_timestamp("ts"))
    e.repartition(3).write.parquet(src)
    stream = ingest.parquet_stream(spark, src, e.schema)
    q = ingest.start_upsert(ingest.new_documents(stream, "checksum", "ts"), str(tmp_path / "t"), str(tmp_path / "c"), "checksum")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    counted = ingest.tumbling_counts(ingest.parquet_stream(spark, src, e.schema), "ts", "checksum")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in ingest.tumbling_counts(e, "ts", "checksum").collect()}
    assert ingest.session_counts(e, "ts", "checksum").count() >= 5 and ingest.sliding_counts(e, "ts", "checksum").count() > 0


def test_ordered_blocks(spark):
    rows = [("hot", i, i * i % 7) for i in range(200)] + [(None, 1, 4), (None, 2, 6), ("b", 5, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = {(r["k"], r["i"]): r["rank"] for r in ranked(df, ["k"], [F.desc("i")]).collect()}
    assert got["hot", 199] == 1 and got["hot", 0] == 200 and got[None, 2] == 1 and got["b", 5] == 1 and len(got) == 203
    sums = {(r["k"], r["i"]): r["s"] for r in running_sum(df, ["k"], [F.col("i")], "v", "s").collect()}
    assert sums["hot", 150] == sum(i * i % 7 for i in range(151)) and sums[None, 2] == 10
    after = {(r["k"], r["i"]): r["n"] for r in shifted(df, ["k"], [F.col("i")], "i", "n").collect()}
    assert after["hot", 77] == 78 and after["hot", 199] is None and after[None, 1] == 2


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("2020-01-01", 5, 7)], "t string, __ts_f int, u int")
    assert normalise_timestamps(df, "t", None, "u").first().asDict() == {"t": "2020-01-01", "__ts_f": 5, "u": 1577836800000000}
