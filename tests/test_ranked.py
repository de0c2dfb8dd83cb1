import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions import names
from leafmill.operators import batches
from leafmill.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_places_of_many_rows_are_those_of_one_sort(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(0, 240_000, 1, 7).select(F.concat(F.lit("scan"), (F.col("id") * 7919 % 30_011).cast("string")).alias("name"), "id")
        placed = batches.ranked(rows, [names.natural_key(F.col("name")), F.col("id")], "place").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    placed["number"] = placed.name.str.slice(4).astype(int)
    wanted = placed.sort_values(["number", "id"]).reset_index(drop=True)
    assert wanted.place.tolist() == list(range(1, 240_001))


def test_null_keys_come_first_and_an_empty_table_stays_empty(spark):
    rows = spark.createDataFrame([("b", 2), (None, 1), ("a", 3), (None, 0)], "k string, id int")
    placed = {r.id: r.place for r in batches.ranked(rows, [F.col("k"), F.col("id")], "place").collect()}
    assert placed == {0: 1, 1: 2, 3: 3, 2: 4}
    assert batches.ranked(rows.where("id < 0"), [F.col("k")], "place").count() == 0


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_natural_order_of_larger_tables(spark, sf_dir, scale):
    folder = sf_dir.replace("sf0.001", scale)
    found = sorted((r.page_id, r.place) for r in QUERIES["natural_order"](spark, folder).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    assert found == sorted((p, n) for p, _, n in duck.execute(ORACLE_SQL["natural_order"]).fetchall())
