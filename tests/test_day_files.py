"""Day files: pruning, projection, commits."""

import os
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.sources import day_files

COLUMNS = "date int, instrument long, close double"


@pytest.fixture
def root(spark, tmp_path):
    rows = spark.createDataFrame([(20200101 + d, i, float(10 * d + i)) for d in range(8) for i in range(50)], COLUMNS)
    day_files.write_days(rows, str(tmp_path / "bars"), ["instrument"])
    return str(tmp_path / "bars")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_rows_come_back_and_stray_names_are_skipped(spark, root):
    os.makedirs(f"{root}/notes")
    os.makedirs(f"{root}/2021")
    for name in ("2020/readme.feather", "2020/2020010.feather", "2020/20200101.csv", "notes/20200101.feather", "2021/.20210101.feather.tmp"):
        with open(f"{root}/{name}", "w") as f:
            f.write("no day")
    rows = day_files.read_days(spark, root)
    assert found(rows) == [(20200101 + d, i, float(10 * d + i)) for d in range(8) for i in range(50)]
    assert found(day_files.calendar(spark, root)) == [(20200101 + d,) for d in range(8)]
    assert sorted(os.listdir(root)) == ["2020", "2021", "notes"]


def test_files_outside_the_dates_are_not_opened(spark, root):
    for d in (1, 2, 8):
        with open(f"{root}/2020/2020010{d}.feather", "wb") as f:
            f.write(b"broken")
    rows = day_files.read_days(spark, root, COLUMNS).where("date > 20200102 and date < 20200108 and close > 40")
    assert rows.rdd.getNumPartitions() == 5
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "GreaterThan(date,20200102)" in plan and "isnotnull(date" not in plan and "ReadSchema: struct<date:int,instrument:bigint,close:double>" in plan
    assert len(found(rows)) == sum(10 * d + i > 40 for d in range(2, 7) for i in range(50))
    assert found(day_files.read_days(spark, root, COLUMNS).where(F.col("date").isin(20200103, 20200105, 20300101)).select("date").distinct()) == [(20200103,), (20200105,)]
    assert day_files.read_days(spark, root, COLUMNS).where("date = 20190101").count() == 0
    with pytest.raises(Exception, match="ArrowInvalid"):
        day_files.read_days(spark, root, COLUMNS).count()


def test_only_wanted_columns_are_read(spark, root):
    """A column of another file's type would fail to convert if it were read."""
    other = pa.table({"instrument": pa.array([1], pa.int64()), "close": ["no number"]})
    with pa.ipc.new_file(f"{root}/2020/20200101.feather", other.schema) as f:
        f.write_table(other)
    rows = day_files.read_days(spark, root, "instrument long, date int, lacking string")
    assert rows.count() == 351 and rows.where("lacking is null").count() == 351
    with pytest.raises(Exception, match="no number"):
        found(day_files.read_days(spark, root, COLUMNS))


def test_days_are_replaced_whole_and_never_half_written(spark, root):
    new = spark.createDataFrame([(20200102, 1, -1.0), (20200120, 1, -2.0)], COLUMNS)
    with pytest.raises(Exception, match="1 days are there already"):
        day_files.write_days(new, root, ["instrument"])
    assert day_files.calendar(spark, root).count() == 8 and os.listdir(root) == ["2020"]
    day_files.write_days(new, root, ["instrument"], replace=True)
    rows = day_files.read_days(spark, root, COLUMNS)
    assert rows.where("date = 20200102").count() == 1 and rows.where("date = 20200103").count() == 50 and rows.where("date = 20200120").count() == 1
    failing = new.withColumn("close", F.when(F.col("date") == 20200120, F.raise_error("killed")).otherwise(0.0).cast("double"))
    with pytest.raises(Exception, match="killed"):
        day_files.write_days(failing, root, ["instrument"], replace=True)
    assert found(rows.where("date in (20200102, 20200120)")) == [(20200102, 1, -1.0), (20200120, 1, -2.0)]


def test_rows_that_do_not_come_by_day_are_refused(spark, tmp_path):
    day_files.register(spark)
    rows = spark.createDataFrame([(20200101 + k % 2, k, 0.0) for k in range(6)], COLUMNS)
    for dealt, said in ((rows.coalesce(1), "must come together"), (rows.repartition(3, "instrument").sortWithinPartitions("date"), "two tasks wrote"), (rows.withColumn("date", F.lit(7)).coalesce(1), "not a date")):
        with pytest.raises(Exception, match=said):
            dealt.write.format("day_files").mode("append").save(str(tmp_path / "x"))
    assert day_files.calendar(spark, str(tmp_path / "x")).count() == 0
    shutil.rmtree(tmp_path / "x", ignore_errors=True)
    none = day_files.read_days(spark, str(tmp_path / "x"), COLUMNS)
    assert none.count() == 0
