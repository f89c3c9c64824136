"""SQL functions against the column functions they stand for."""

import random

from pyspark.sql import functions as F

from csvharbor.functions import cells, messages, sql

ATOMS = ["=", '"', "'", "netsuite:", " ", "\t", "　", "$", "(", ")", "-", "+", ",", ".", "1", "24", "2024", "/", "Jan", "15", "e", "yes", "N", "texas", "TX", "€", "\n", "timeout"]


def test_same_as_column_functions(spark):
    sql.register(spark)
    rng = random.Random(4)
    texts = ["".join(rng.choices(ATOMS, k=rng.randint(0, 6))) for _ in range(1500)]
    texts += ["1/2/24", "12-31-99", "2024-02-30", "20240115", "Jan 15, 2024", "15 Jan 2024", "(1,234.50)", "($ 5)", '="x"', "New York", "ny", None, "FALSE", "1e5", "2024-1-05", "1.2.2024"]
    spark.createDataFrame([(t,) for t in texts], "t string").createOrReplaceTempView("texts")
    t = F.col("t")
    pairs = {
        "csv_clean_cell(t)": cells.clean_cell(t), "csv_text(t)": cells.to_text(t), "csv_numeric(t)": cells.to_numeric(t), "csv_bool(t)": cells.to_bool(t),
        "csv_date(t, 2026)": cells.to_date(t, 2026), "csv_us_state(t)": cells.normalize_us_state(t), "csv_error_code(t)": messages.error_code(t),
        "csv_severity(t)": messages.severity(t),
    }
    for call, column in pairs.items():
        differing = spark.table("texts").select(t, F.expr(call).alias("a"), column.alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))
        assert differing.take(3) == [], call
    plan = spark.sql("SELECT csv_date(csv_clean_cell(t), 2026), csv_numeric(t) FROM texts")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
