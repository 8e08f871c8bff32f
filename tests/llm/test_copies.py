from lexoria.llm.queries import p2_found


def test_all_copies_are_paired(spark, tmp_path):
    same = "una doi trei patru cinci șase șapte opt nouă zece unsprezece doisprezece"
    rows = [(i, same) for i in range(1, 13)] + [(20, same.replace("doisprezece", "treisprezece"))]
    spark.createDataFrame(rows, "def_id long, definition string").write.parquet(f"{tmp_path}/definitions.parquet")
    spark.createDataFrame([], "meaning_id long, text string").write.parquet(f"{tmp_path}/meanings.parquet")
    ids = [i for i, _ in rows]
    assert {(r.id_a, r.id_b) for r in p2_found(spark, str(tmp_path)).collect()} == {(a, b) for a in ids for b in ids if a < b}
