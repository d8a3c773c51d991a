"""Every panel query against its SQL, on whole tables."""

import pytest
from helpers import SF, oracle_rows, rows_of

from barloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        names, rows = oracle_rows(registry.ORACLE_SQL[name])
        assert names == sorted(df.columns)
        assert rows_of(df) == rows
    else:
        assert df.count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_regimes_of_dates_whose_sums_change_from_one_computation_to_the_next(spark, monkeypatch):
    from pyspark.sql import functions as F

    from barloom.plans import evaluation

    def bars(spark, sf):
        rows = [(year * 10000 + 101, year, k, instrument, 100.0 + (7 * k + 3 * instrument + year) % 11) for year in (1996, 1997, 1998) for k in range(12) for instrument in (1, 2)]
        df = spark.createDataFrame(rows, "date int, year int, minute_index int, instrument long, close double")
        later = F.unix_micros(F.current_timestamp()) / 1e12  # grows from job to job, as the last digits of a sum of doubles change
        return df.withColumns({"datetime": F.make_timestamp_ntz("year", F.col("minute_index") + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)), "amount": F.col("year") - later}).drop("year")

    monkeypatch.setattr(evaluation.src, "monthly_bars", bars)
    rows = evaluation.regime_metrics(spark, "").where("family = 'amount' and model_name = 'model_a'").collect()
    n = {r["regime"]: r["n"] for r in rows}
    assert 1.8 < n["high"] / n["low"] < 2.3  # two of three dates are at the median or above
