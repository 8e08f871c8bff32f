import json

import pytest
from pyspark.sql import functions as F

from lexoria.functions import codec
from lexoria.functions.html import best_texts, html_entries
from lexoria.sources import dump, files, sinks


def test_dump(spark):
    lines = [
        r"INSERT INTO `Def` VALUES (1,'a (b), \'c\' \\ d\nx',NULL,3.5),(2,'',7,NULL),(3,'ș;),(','NULL',1);",
        "INSERT INTO `Other` VALUES (9,'x');", "-- comment", "INSERT INTO `Def` VALUES (4,'short');", "INSERT INTO `Def` VALUES (5,'" + "long (text) " * 30_000 + "',1,1);", None,
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    cols = {"id": (0, "long"), "text": (1, "string"), "n": (2, "int")}
    got = {r.id: (r.text, r.n) for r in dump.dump_table(df, "Def", cols).collect()}
    assert got[1] == ("a (b), 'c' \\ dnx", None) and got[2] == ("", 7) and got[3] == ("ș;),(", None) and got[4] == ("short", None)
    assert len(got[5][0]) == 12 * 30_000
    text = {r.id: r.text for r in dump.dump_table(df, "Def", cols, collapse=True).collect()}
    assert text[1] == "a (b), 'c' \\ d x" and text[2] is None
    assert [r.id for r in dump.dump_table(df, "Def", cols, where=F.col("tuple").rlike("^2,")).collect()] == [2]
    assert dump.dump_table(df.where("value is null"), "Def", cols).count() == 0


def test_rendered_rows_come_back(spark):
    rows = [(i, f"x'{i}\\y\n\"", None if i % 3 else "ș") for i in range(200)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    got = dump.dump_table(dump.render(df, "T", ["i", "a", "b"], 7), "T", {"i": (0, "long"), "a": (1, "string"), "b": (2, "string")})
    assert {tuple(r) for r in got.collect()} == {(i, a, b) for i, a, b in rows}


def test_frequency_lines(spark):
    lines = ["a\t1", "A\t2", "b\tx", "c", "d\t1\t2", "\t5", " ş\t3", "s̡\t1", None]
    counts, tally = files.frequency_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.word: r["count"] for r in counts.collect()}["a"] == 3
    assert tuple(tally.first()) == (9, 5)


def test_novels_registry_and_references(spark):
    rows = [("/z/1890_Ion Pop_Titlu.json", json.dumps({"1": ["a", "b"], "2": ["c"]})), ("/z/x.json", "broken")]
    got = [tuple(r) for r in files.novels(spark.createDataFrame(rows, "path string, value string")).collect()]
    assert got[0] == (1890, "Ion Pop", "Titlu", "a b c") and got[1][:3] == (None, None, None)
    reg = spark.createDataFrame([(1, "# x\ty"), (2, ""), (3, "a\t1"), (4, "a\t2\t3"), (5, "b"), (6, None)], "o int, value string")
    assert {r.name: r.value for r in files.registry(reg, "o").collect()} == {"a": "2\t3", "b": ""}
    ref = spark.createDataFrame([('[["Şir|s.","12"],["x"]]',), (None,)], "value string")
    assert [tuple(r) for r in files.cross_references(ref).collect()] == [("șir", "12")]


def test_html(spark):
    page = '<div class="defWrapper x"><p class="def">A &lt; <b>b</b><br>c</p><span class="defDetails"><a class="ref" href="/sursa/ed2">ED</a></span></div>' * 2 + "<div class='defWrapper'>no body</div><div"
    e = html_entries()(F.col("h"))
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(e.alias("e"))
    got = [[tuple(x) for x in r.e] for r in df.collect()]
    assert got == [[("ed2", "A < bc")] * 2, [], []]
    assert [r.t for r in df.select(best_texts("e", ["ed2"], 1).alias("t")).collect()] == ["A < bc", None, None]


def test_codec(spark):
    rows = [("u", 2, 35), ("u", 1, 36), ("u", 3, None), ("v", 1, 2_000_000_000)]
    packed = codec.pack_ids(spark.createDataFrame(rows, "k string, p int, w long"), "k", "p", "w")
    assert {r.k: r.packed for r in packed.collect()} == {"u": "1.10.z", "v": "1.x2qxvk"}
    bad = spark.createDataFrame([("a", "1.10..0.zzzzzzz.Z.z"), ("b", "2.10"), ("c", None), ("d", "1")], "k string, packed string")
    assert {(r.k, r.position, r.word_id) for r in codec.unpack_ids(bad, "k").collect()} == {("a", 0, 36), ("a", 5, 35)}


def test_sinks(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    df = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, n long, t long")
    for _ in range(2):
        got = sinks.accumulate(spark, at("acc"), df, ["k"], ["n"], ["t"])
    assert {tuple(r) for r in got.select("k", "n", "t").collect()} == {("a", 2, 10), ("b", 4, 20)}
    sinks.create_table(df, at("new"))
    with pytest.raises(Exception, match="exist"):
        sinks.create_table(df, at("new"))
    sinks.upsert(spark, at("up"), df, ["k"], ["t"])
    up = sinks.upsert(spark, at("up"), spark.createDataFrame([("a", 9, 5), ("c", 3, 1)], df.schema), ["k"], ["t"])
    assert {tuple(r) for r in up.collect()} == {("a", 1, 10), ("b", 2, 20), ("c", 3, 1)}
    sinks.replace_partitions(df, at("parts"), "k")
    sinks.replace_partitions(spark.createDataFrame([("a", 7, 7)], df.schema), at("parts"), "k")
    assert {(r.k, r.n) for r in spark.read.parquet(at("parts")).collect()} == {("a", 7), ("b", 2)}
    sinks.append_history(df, at("h")), sinks.append_history(df, at("h"))
    assert spark.read.json(at("h")).count() == 4
    sinks.write_csv(spark.createDataFrame([('x "q", y', 1.0), (None, 2.25)], "a string, b double"), at("c"), {"b": 1})
    assert {tuple(r) for r in files.read_csv(spark, at("c"), "a string, b double").collect()} == {('x "q", y', 1.0), (None, 2.3)}
    sinks.write_lines(df, at("l"), F.col("k"))
    assert spark.read.text(at("l")).count() == 2
    assert [r.k for r in sinks.keep_newest(df, "t", "k", 1).collect()] == ["b"]


def test_a_table_is_never_missing_while_it_is_replaced(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    sinks.replace_table(one(1), path)
    before = sinks.read_table(spark, path)
    sinks.replace_table(one(2), path)
    assert before.first().n == 1 and sinks.read_table(spark, path).first().n == 2

    def fails(*_, **__):
        raise OSError("stopped")

    monkeypatch.setattr(sinks, "rename", fails)
    with pytest.raises(OSError):
        sinks.replace_table(one(3), path)
    monkeypatch.undo()
    assert sinks.read_table(spark, path).first().n == 2
    sinks.replace_table(sinks.read_table(spark, path).selectExpr("n + 2 as n"), path)
    assert sinks.read_table(spark, path).first().n == 4 and len(sinks._versions(spark, path)) == 2
    assert sinks.upsert(spark, f"{path}2", one(1), ["n"], ["n"]).count() == 1 and sinks.upsert(spark, f"{path}2", one(5), ["n"], ["n"]).count() == 2
