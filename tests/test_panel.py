import pytest
from pyspark.sql import functions as F

from ripplecart.config import CELL, HIERARCHY
from ripplecart.functions.distributed import settled
from ripplecart.functions.scalars import digits_below, discount_rate, edge_weight, flag_active, hash_digits, hash_uniform
from ripplecart.operators import panel as P
from ripplecart.sources import csv_tables, stores

TX = "STORE_ID bigint, PRODUCT_ID bigint, WEEK_NO int, QUANTITY double, SALES_VALUE double, RETAIL_DISC double"


@pytest.fixture(scope="module")
def tx(spark):
    rows = [
        (1, 10, 1, 2.0, 8.0, -2.0), (1, 10, 1, 1.0, 4.0, 0.0), (1, 10, 4, 1.0, 5.0, 0.0),
        (2, 10, 2, 3.0, 9.0, -1.0), (2, 20, 3, None, None, None), (2, 20, 5, 1.0, 0.0, 0.0),
        (None, 10, 9, 1.0, 1.0, 0.0), (1, None, 9, 1.0, 1.0, 0.0),
    ]
    return spark.createDataFrame(rows, TX)


@pytest.fixture(scope="module")
def product(spark):
    return spark.createDataFrame(
        [(10, "D1", "C1", "S1", "National"), (20, "D2", "C2", None, "Private")],
        "PRODUCT_ID bigint, DEPARTMENT string, COMMODITY_DESC string, SUB_COMMODITY_DESC string, BRAND string",
    )


def test_flags_decode_missing_as_active_and_strip_all_whitespace(spark):
    df = spark.createDataFrame([("0",), (" 0",), ("\t0 \n",), ("A",), (None,), ("",), ("0.0",)], "f string")
    assert [r[0] for r in df.select(flag_active(F.col("f"))).collect()] == [0, 0, 0, 1, 1, 1, 1]


def test_discount_rate_takes_abs_of_the_sum_and_guards_zero(spark):
    df = spark.createDataFrame([(8.0, -2.0), (0.0, 0.0), (6.0, 2.0)], "s double, d double")
    assert [r[0] for r in df.select(discount_rate(F.col("s"), F.col("d"))).collect()] == [0.2, 0.0, 0.25]


def test_cells_drop_null_keys_and_sum_nulls_to_zero(tx):
    cells = {tuple(r[c] for c in CELL): r for r in P.aggregate_cells(tx).collect()}
    assert set(cells) == {(1, 10, 1), (1, 10, 4), (2, 10, 2), (2, 20, 3), (2, 20, 5)}
    assert cells[1, 10, 1].units_sold == 3.0 and cells[1, 10, 1].sales_value == 12.0
    assert cells[1, 10, 1].discount_rate == pytest.approx(2 / 14)
    assert cells[2, 20, 3].units_sold == 0.0 and cells[2, 20, 3].discount_rate == 0.0


def test_dense_index_uses_the_range_over_all_stores(tx):
    got = {tuple(r[c] for c in CELL) for r in P.dense_index(P.aggregate_cells(tx)).collect()}
    want = {(s, 10, w) for s in (1, 2) for w in range(1, 5)} | {(2, 20, w) for w in range(3, 6)}
    assert got == want


def test_panel_fills_and_multiplies_on_duplicate_flags(spark, tx, product):
    flags = spark.createDataFrame(
        [(1, 10, 1, "0", "D"), (2, 10, 2, None, " 0 "), (2, 10, 3, "0", "0"), (2, 20, 5, "1", "0"), (2, 20, 5, "0", "0"), (9, 9, 9, "1", "1")],
        "STORE_ID bigint, PRODUCT_ID bigint, WEEK_NO int, display string, mailer string",
    )
    rows = P.build_panel(tx, flags, product).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault((r.STORE_ID, r.PRODUCT_ID, r.WEEK_NO), []).append(r)
    assert (by[1, 10, 1][0].display, by[1, 10, 1][0].mailer, by[1, 10, 1][0].promo_any) == (0, 1, 1)
    assert (by[2, 10, 2][0].display, by[2, 10, 2][0].promo_any) == (1, 1)
    assert by[1, 10, 2][0].units_sold == 0.0 and by[1, 10, 2][0].promo_any == 0 and by[1, 10, 2][0].sold_any == 0
    assert sorted(r.promo_any for r in by[2, 20, 5]) == [0, 1]
    assert by[2, 20, 4][0].SUB_COMMODITY_DESC is None and by[2, 20, 4][0].DEPARTMENT == "D2"
    assert by[2, 20, 3][0].sold_any == 0


def test_splits_are_inclusive_and_leave_outsiders_out(spark):
    df = spark.createDataFrame([(w,) for w in range(1, 11)], "WEEK_NO int")
    parts = P.temporal_split(df, (1, 3), (4, 5), (7, 8))
    assert {k: sorted(r[0] for r in v.collect()) for k, v in parts.items()} == {"train": [1, 2, 3], "val": [4, 5], "test": [7, 8]}
    assert P.with_split(df, (1, 3), (4, 5), (7, 8)).filter("split is null").count() == 3


def test_demand_filter_keeps_the_threshold_itself(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.9)], "PRODUCT_ID bigint, units_sold double")
    assert {r[0] for r in P.demand_filter(df, 1.0).collect()} == {1}
    assert P.demand_filter(df, None).count() == 4


def test_unknown_weight_type_is_rejected():
    with pytest.raises(ValueError):
        edge_weight("other", None)


def test_csv_reader_strips_headers_and_keeps_flag_codes(spark, tmp_path):
    path = tmp_path / "causal_data.csv"
    path.write_text(" PRODUCT_ID ,STORE_ID,WEEK_NO, display , mailer\n10,1,1,0,A\n10,1,2,,0\n")
    df = csv_tables.read_csv_table(spark, str(path))
    assert df.columns == ["PRODUCT_ID", "STORE_ID", "WEEK_NO", "display", "mailer"]
    assert dict(df.dtypes)["display"] == "string" and dict(df.dtypes)["PRODUCT_ID"] == "bigint"
    flags = P.promo_flags(df).orderBy("WEEK_NO").collect()
    assert [(r.display, r.mailer, r.promo_any) for r in flags] == [(0, 1, 1), (1, 0, 1)]
    assert csv_tables.read_csv_table(spark, str(path), ["STORE_ID"]).columns == ["STORE_ID"]


def test_result_tables_round_trip_and_fall_back(spark, tmp_path):
    table = spark.createDataFrame([("m", "direct", 1.0, 0.1, 0.8, 1.2, 5)], stores.RESULT_SCHEMA)
    path = str(tmp_path / "results")
    missing = stores.read_result_or(spark, path, lambda: table.limit(0))
    assert missing.count() == 0
    stores.write_result(table, path)
    assert stores.read_result_or(spark, path, lambda: table.limit(0)).collect() == table.collect()


def test_panel_store_prunes_weeks(spark, tx, product, tmp_path):
    flags = spark.createDataFrame([], "STORE_ID bigint, PRODUCT_ID bigint, WEEK_NO int, display string, mailer string")
    panel = P.build_panel(tx, flags, product)
    stores.write_panel(panel, str(tmp_path / "panel"))
    back = stores.read_panel(spark, str(tmp_path / "panel"))
    assert back.count() == panel.count() and set(back.columns) == set(panel.columns) and set(HIERARCHY) <= set(back.columns)
    plan = back.filter("WEEK_NO between 2 and 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(WEEK_NO" in plan


def test_malformed_numbers_end_the_read(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("STORE_ID,QUANTITY\n1,2\n1,two\n2,\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_tables.read_csv_table(spark, str(path)).collect()
    lenient = csv_tables.read_csv_table(spark, str(path), mode="PERMISSIVE").collect()
    assert [r.QUANTITY for r in lenient] == [2.0, None, None]


def test_panel_reads_its_lines_once(spark):
    tx = spark.createDataFrame([(1, 1, 1, 1.0, 1.0, 0.0), (1, 1, 3, 2.0, 2.0, 0.0)], TX)
    flag_cols = "STORE_ID bigint, PRODUCT_ID bigint, WEEK_NO int, display string, mailer string"
    labels = ", ".join(f"{c} string" for c in HIERARCHY)
    product = spark.createDataFrame([(1, "a", "b", "c", "d")], f"PRODUCT_ID bigint, {labels}")
    out = P.build_panel(tx, spark.createDataFrame([], flag_cols), product)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "QUANTITY" not in text and out.count() == 3


def test_a_panel_larger_than_its_lines_is_expanded_in_many_tasks_and_never_shuffled(spark):
    ends = [(s, p, w, 1.0, 1.0, 0.0) for s in (1, 2) for p in range(1, 61) for w in (1, 1000)]
    cells = settled(P.aggregate_cells(spark.createDataFrame(ends, TX)))
    parts = P.dense_parts(cells)
    assert parts == 3  # 120,000 rows out of 240 cells
    flags = P.dense_index(cells, parts).select(*CELL, F.lit("0").alias("display"), F.lit("D").alias("mailer"))
    product = spark.range(1, 61).select(F.col("id").alias("PRODUCT_ID"), *[F.lit("x").alias(c) for c in HIERARCHY])
    out = P.panel_of_cells(cells, flags, product, parts)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() == 3
    assert out.count() == 120_000 and out.filter("mailer = 1 and display = 0 and promo_any = 1").count() == 120_000
    assert text.count("SortMergeJoin") == 2
    for line in text.split("\n"):
        assert "Exchange hashpartitioning" not in line or "(PRODUCT_ID" in line  # cells alone, by product
    assert text.count("Exchange hashpartitioning") == 3


def test_digits_compare_as_their_uniforms_do(spark):
    key = F.col("id").cast("string")
    bounds = (0.02, 0.1, 0.12, 0.2, 0.5, 0.999)
    rows = spark.range(5000)
    for t in bounds:
        assert rows.filter(digits_below(hash_digits("d", key), t) != (hash_uniform("d", key) < t)).count() == 0
    assert 0 < rows.filter(digits_below(hash_digits("d", key), 0.02)).count() < 200
