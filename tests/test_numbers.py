"""Numbers in texts, as the reference's first_number_text reads them (no number: '')."""

from pyspark.sql import functions as F

from fieldloom.functions import numbers

CASES = {".5": "0.5", "-.25 m": "-0.25", "+3": "3", "+.5": "0.5", "５０": "50", "－１，２３４．５ m": "-1234.5", "약 25.5 m": "25.5", "1,234": "1234", "5.": "5", "a1.2.3": "1.2", "-7": "-7", "없음": "", "": "", "+-": "", None: ""}


def test_first_number(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    assert {r[0]: r[1] for r in df.select("t", numbers.first_number(F.col("t"))).collect()} == CASES
