"""Security keys of every market and form; wrong lengths have none."""

from pyspark.sql import functions as F

from marlstone.operators.entities import security_key


def test_security_key(spark):
    want = {
        "hk:700": ("HK", "00700", None), "HK:123456": None, "US:brk.b": ("US", "BRK.B", None), "US:1A": None, "TW:2330": ("TW", "2330", None), "TW:233": None,
        "SH:600000": ("SH", "600000", None), "SZ:1": None, " 700  HK ": ("HK", "00700", None), "5.HK": ("HK", "00005", None), "600000.SS": ("SH", "600000", None),
        "000001SZ": ("SZ", "000001", None), "2330 TT": ("TW", "2330", None), "600519 CH": ("CN", "600519", None), "60051 CH": None, "123456.HK": None,
        "AAPL.OQ": ("US", "AAPL", "Nasdaq"), "IBM N": ("US", "IBM", "NYSE"), "IBM US": ("US", "IBM", None), "700": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "raw string").select("raw", security_key(F.col("raw")).alias("key"))
    assert {r["raw"]: r["key"] and tuple(r["key"]) for r in df.collect()} == want
