from grovekit.plans import catalog


def test_every_row_has_its_key(spark, tmp_path):
    names = ["BATUAH_T02B_0045\t", "\tMERANTU_F01B_0118 ", "KELUNA_M01D_0082", "MERANTU_L02C_0065_ulang3\t", "A\tB_7", None]
    spark.createDataFrame(list(enumerate(names)), "row_id bigint, tree_id string").write.parquet(f"{tmp_path}/split_manifest.parquet")
    got = {r.row_id: (r.tree, r.side) for r in catalog.build().queries["src_06_key_parsing"](spark, str(tmp_path)).collect()}
    assert got == {0: ("BATUAH_T02B", 45), 1: ("MERANTU_F01B", 118), 2: ("KELUNA_M01D", 82), 3: ("MERANTU_L02C_0065_ulang3", None), 4: ("A\tB", 7), 5: (None, None)}
