from lexoria.plans.queries_sources import QUERIES


def test_all_fields_by_position(spark, tmp_path):
    cols = "id long, parentId long, value string, color int, icon string, iconOnly int, tooltip string, public int, isPos int, createDate long, modDate long"
    row = (7, None, "a'b,(c)", 3, None, 0, "", 1, None, 11, 12)
    spark.createDataFrame([row], cols).write.parquet(f"{tmp_path}/tag.parquet")
    got = {r.position: r.value for r in QUERIES["src_05_fields"](spark, str(tmp_path)).collect()}
    assert got == {i: None if v is None else str(v) for i, v in enumerate(row)}
