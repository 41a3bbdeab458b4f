"""Each check of the preps raises, and the NULL report comes from the job that writes the rows."""

import pytest

from loanpanel.operators.guards import RowChecks
from loanpanel.operators.prep import prep_monthly, prep_origination


def origination(spark, **changes):
    row = {"loanSeqNumber": "L1", "creditScore": "700", "origLoanTerm": 360, "borrowers": 2, "channel": "R", "firstTimeBuyFlag": "Y"}
    rows = [tuple({**row, "loanSeqNumber": f"L{i}", **(changes if changes.pop("all", False) or i == 1 else {})}.values()) for i in range(4)]
    return spark.createDataFrame(rows, "loanSeqNumber string, creditScore string, origLoanTerm int, borrowers int, channel string, firstTimeBuyFlag string")


def prepare(df):
    checks = RowChecks()
    rows = prep_origination(df, keep=["loanSeqNumber", "borrowers", "origLoanTerm", "channel_R"], checks=checks).collect()
    checks.verify()
    return rows, checks


def test_clean_rows_pass_and_are_projected(spark):
    rows, checks = prepare(origination(spark))
    assert rows[0].__fields__ == ["loanSeqNumber", "borrowers", "origLoanTerm", "channel_R"]
    assert checks.rows("loaded") == checks.rows("prepared") == 4 and set(checks.null_counts("prepared").values()) == {0}


@pytest.mark.parametrize("column", ["origLoanTerm", "borrowers"])
def test_a_null_term_or_borrower_raises(spark, column):
    with pytest.raises(ValueError, match=f"NULL values in .*{column}"):
        prepare(origination(spark, **{column: None}))


def test_a_column_without_any_value_raises(spark):
    from pyspark.sql import functions as F
    df = origination(spark).withColumn("channel", F.lit(None).cast("string"))
    checks = RowChecks()
    prep_origination(df, channel_values=["R"], checks=checks).collect()
    with pytest.raises(ValueError, match="loaded: .*all NULL values: .*channel"):
        checks.verify()


def test_lost_rows_raise(spark):
    checks = RowChecks()
    df = checks.watch(spark.range(10).toDF("id"), "before")
    checks.watch(df.where("id > 3"), "after").collect()
    checks.verify()
    with pytest.raises(ValueError, match="10 rows in before, 6 in after"):
        checks.verify([("before", "after")])
    with pytest.raises(ValueError):
        checks.watch(df, "before")


def test_null_report_of_the_monthly_prep(spark):
    df = spark.createDataFrame([("a", "202001", None, "0"), ("b", "202002", "5.0", None), ("c", None, "1", "1")], "loanSeqNumber string, mthlyRepPeriod string, loanAge string, currLoanDelinqStatus string")
    checks = RowChecks()
    assert prep_monthly(df, checks=checks).count() == 2
    nulls = checks.null_counts("prepared")
    assert checks.rows("prepared") == 2 and nulls["loanAge"] == 1 and nulls["mthlyRepPeriod"] == 0


def test_empty_input(spark):
    checks = RowChecks()
    assert prep_origination(origination(spark).where("false"), channel_values=["R"], checks=checks).collect() == []
    checks.verify()
