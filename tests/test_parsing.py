from pyspark.sql import functions as F
import pytest

from cohortflow.functions import derive as D
from cohortflow.functions import parsing as P

TEXTS = ["1.5", "1,5", "1,234", "1,2345", "1.234,5", "'7'", '"7"', "NA", "N/A", "<NA>", "None", "", "inf", "abc"]

# One expected value per text and reader; the readers differ on commas and on missing texts.
EXPECTED = {
    P.parse_number_decimal_comma: [1.5, 1.5, 1.234, 1.2345, None, 7.0, 7.0, None, None, None, None, None, None, None],
    P.parse_float_mixed: [1.5, 1.5, 1.234, 12345.0, 1.2345, 7.0, 7.0, None, None, None, None, None, None, None],
    P.parse_number_na_list: [1.5, 1.5, 1.234, 1.2345, None, 7.0, 7.0, None, None, None, None, None, None, None],
    P.parse_number_regex: [1.5, 1.5, 1.234, 1.2345, None, None, None, None, None, None, None, None, None, None],
}


@pytest.mark.parametrize("reader", list(EXPECTED), ids=lambda r: r.__name__)
def test_number_readers(spark, reader):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TEXTS)], "i int, s string")
    got = [r.v for r in df.select("i", reader(F.col("s")).alias("v")).orderBy("i").collect()]
    assert got == EXPECTED[reader]


def test_codes_and_flags(spark):
    df = spark.createDataFrame([("3",), ("3.0",), ("3,0",), (" x ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(P.normalise_code(F.col("s"))).collect()] == ["3", "3", "3", "x", None, None]
    codes = spark.createDataFrame([("1",), ("0",), ("2",), ("1,5",), (None,)], "s string")
    flags = codes.select(P.flag_01(P.parse_integer_code(F.col("s"))))
    assert [r[0] for r in flags.collect()] == [True, False, None, None, None]


def test_label_text_rejects_unknown(spark):
    df = spark.createDataFrame([(" YES ",), ("low",), ("Positive",)], "s string")
    assert [r[0] for r in df.select(P.required_binary_label(F.col("s"))).collect()] == [1, 0, 1]
    with pytest.raises(Exception, match="unsupported label"):
        spark.createDataFrame([("maybe",)], "s string").select(P.required_binary_label(F.col("s"))).collect()


def test_entity_id_and_nan(spark):
    df = spark.createDataFrame([("P0001",), ("P0001_H",), ("Q1",)], "s string")
    assert [r[0] for r in df.select(P.entity_id_from_name(F.col("s"))).collect()] == ["P0001", "P0001", None]
    x = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in x.select(P.nan_to_null(F.col("x"))).collect()] == [1.0, None, None, None]


def test_class_indicator_and_fingerprint(spark):
    df = spark.createDataFrame([(3.0,), (2.0,), (None,)], "c double")
    assert [r[0] for r in df.select(D.class_indicator(F.col("c"), 3.0, [2.0, 3.0])).collect()] == [1.0, 0.0, None]
    with pytest.raises(Exception, match="unexpected class"):
        spark.createDataFrame([(4.0,)], "c double").select(D.class_indicator(F.col("c"), 3.0, [2.0, 3.0])).collect()
    rows = spark.createDataFrame([("a", None), ("a", "b"), (None, "b")], "x string, y string")
    assert rows.select(D.row_fingerprint("x", "y").alias("f")).distinct().count() == 3
