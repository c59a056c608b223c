import datetime as dt

from pyspark.sql import functions as F

from orderlens.functions import columns as fc
from orderlens.functions import text


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_zip(spark):
    assert one(spark, ["1234", "12345.0", "12345-6789", "nan", "12", None, "123456"], fc.parse_zip("v")) == [
        "01234", "12345", "123456789", None, None, None, None]


def test_flags_and_state(spark):
    raw = ["Y", " true ", "n", "0", "maybe", None]
    assert one(spark, raw, fc.flag_to_yn("v")) == ["Y", "Y", "N", "N", None, None]
    assert one(spark, raw, fc.flag_to_int("v")) == [1, 1, 0, 0, 0, 0]
    assert one(spark, [" ny", "N1", "NYC", None], fc.clean_state("v")) == ["NY", None, None, None]


def test_dates(spark):
    ids = ["20240229", "20230229", "20241231", "0"]
    assert one(spark, ids, fc.try_date("v")) == [dt.date(2024, 2, 29), None, dt.date(2024, 12, 31), None]
    parts = fc.date_parts("v")
    assert one(spark, ids[:1], parts["order_year"]) == [2024]
    assert one(spark, ids[:1], parts["order_month"]) == [2]
    assert one(spark, ids[:1], parts["order_day"]) == [29]


def test_half_up(spark):
    df = spark.range(1).select(fc.half_up(F.lit(45317.8) / 8, 2).alias("a"), fc.half_up(F.lit(2.675), 2).alias("b"))
    assert tuple(df.first()) == (5664.73, 2.68)


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, "x")], "b int, c string")
    assert df.select(fc.resolve_column(df, ["a", "c", "b"])).first()[0] == "x"
    assert df.select(fc.resolve_column(df, ["z"])).first()[0] is None


def test_description_parsers(spark):
    d = [None, "GAUZE", "HYDROCORTISONE+ALOE, CRM 1OZ", "MAPAP, TABS 500MG", "Pad/wipe box"]
    assert one(spark, d, text.product_type("v")) == ["", "GAUZE", "HYDROCORTISONE", "MAPAP", "PAD"]
    assert one(spark, d, text.form_code("v")) == ["", "", "CRM", "TAB", "PAD"]


def test_variants(spark):
    d = ["Gauze Pad 4x4 inch Sterile", "Gauze Pad 2x2 inch Sterile", "XL"]
    stems = one(spark, d, text.variant_stem("v"))
    assert stems[0] == stems[1] == "gauze pad sterile"
    df = spark.createDataFrame([(i, v, "Fam", "Cat", 0) for i, v in enumerate(d)], "i int, v string, f string, c string, p int")
    keys = [r[0] for r in df.orderBy("i").select(text.variant_group_key("i", "v", "f", "c", "p")).collect()]
    assert keys == ["fam|cat|0|gauze pad sterile"] * 2 + ["solo:2"]
    assert one(spark, d[:1] + ["Plain"], text.variant_label("v")) == ["4x4 inch", "Plain"]


def test_archetypes(spark):
    d = ["VA HOSPITAL", "Home Health Agency", "DERMATOLOGY", "", None, "Family Practice"]
    assert one(spark, d, text.archetype_by_description("v")) == [
        "government", "home_care_provider", "specialty_clinic", "unknown", "unknown", "primary_care"]
    code = text.archetype_by_code("v", F.lit(""), F.lit("PO"))
    assert one(spark, ["FP", "VET", "ZZ", None], code) == ["primary_care", "veterinary", "specialty_clinic", "unknown"]
    assert one(spark, ["FP"], text.archetype_by_code("v", F.lit(""), F.lit("AC"))) == ["hospital_acute"]


def test_display_name(spark):
    from orderlens.params import MARKET_NAMES, SIZE_NAMES
    assert one(spark, ["LTC_mid", "ODD_new", "plain", None], text.display_name("v", MARKET_NAMES, SIZE_NAMES)) == [
        "Long-Term Care, Mid-Market", "ODD, New Customer", "plain", None]
