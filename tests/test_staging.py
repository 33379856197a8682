import os

from mosslight import staging


def test_stage_and_clear(spark):
    staging.clear(spark)
    table = staging.stage(spark.range(5).selectExpr("id", "cast(null as string) as s"), "numbers")
    path = table.inputFiles()[0].removeprefix("file://")
    assert table.count() == 5 and os.path.exists(path)
    assert staging.clear(spark) == 1 and not os.path.exists(path)


def test_release_keeps_the_last(spark):
    staging.clear(spark)
    kept = staging.stage(spark.range(1), "before")
    mark = staging.written()
    tables = [staging.stage(spark.range(i), "inner") for i in (2, 3)]
    assert staging.release(spark, mark) == 1 and staging.written() == mark + 1
    assert kept.count() == 1 and tables[1].count() == 3 and not os.path.exists(tables[0].inputFiles()[0].removeprefix("file://"))
    before = staging.generation()
    assert staging.clear(spark) == 2 and staging.generation() != before


def test_placed_rows(spark, tmp_path):
    spark.range(40).selectExpr("id", "id % 3 as `_x`", "'a' as `d.e`").repartition(3).write.parquet(str(tmp_path / "t"))
    scan, staged = spark.read.parquet(str(tmp_path / "t")), staging.written()
    for df, stages in ((scan, 0), (scan.where("id > 4").select("id", "`d.e`"), 0), (scan.unionByName(scan), 1), (scan.selectExpr("id as `_metadata`"), 1), (spark.range(0), 1), (scan.selectExpr("id", "rand() as r"), 1)):
        rows = staging.placed(df)
        assert staging.written() - staged == stages
        staged = staging.written()
        assert rows.select("row.*").columns == df.columns and rows.select("place_file", "place_row").distinct().count() == rows.count() == df.count()
    first, again = (staging.placed(scan.where("id < 9")).select("row.id", "place_file", "place_row") for _ in range(2))
    assert sorted(first.collect()) == sorted(again.collect())
