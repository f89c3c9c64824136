"""Input/expected pairs for every scalar function, one Spark job per function."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from csvharbor.functions import cells

AS_OF = 2026


def results(spark, inputs, fn):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "n int, v string").repartition(2)
    return [r.out for r in df.select("n", fn(F.col("v")).alias("out")).orderBy("n").collect()]


def check(spark, pairs, fn):
    got = results(spark, [p[0] for p in pairs], fn)
    wrong = [(p[0], p[1], g) for p, g in zip(pairs, got) if p[1] != g]
    assert not wrong


def test_to_numeric(spark):
    good = {
        "123": "123", "0": "0", "-456": "-456", "123.45": "123.45", "-123.45": "-123.45", ".99": "0.99", "99.": "99",
        "$1,234.56": "1234.56", "€1234.56": "1234.56", "£1234.56": "1234.56", "1,234,567.89": "1234567.89",
        "1,000,000": "1000000", "(123.45)": "-123.45", "($1,234.56)": "-1234.56", "( 999.99 )": "-999.99",
        "+123": "123", "  123  ": "123", "  7\t": "7", "$ 5": "5", "($ 5)": "-5",
    }
    bad = ["1.5e10", "1.5e-3", "1.5E10", "1.5e+10", "", "   ", "abc", "12abc34", "$", "$,", "12.34.56", "--123", "123-",
           "NaN", "Infinity", "-Infinity", "(-5)", "- 5", "(", "()"]
    check(spark, [(k, Decimal(v)) for k, v in good.items()] + [(b, None) for b in bad], cells.to_numeric)


def test_to_date(spark):
    day = dt.date(2024, 1, 15)
    same = ["2024-01-15", "01/15/2024", "1/15/2024", "01-15-2024", "01.15.2024", "2024/01/15", "2024.01.15",
            "Jan 15, 2024", "15 Jan 2024", "20240115", "  2024-01-15  ", "jan 15, 2024", "Jan  15,  2024"]
    bad = ["", "   ", "not-a-date", "hello world", "2024-13-01", "2024-01-32", "2023-02-29", "2024-00-15", "2024-01-00",
           "January 15, 2024", "2024/1/5", "01/15-2024", "20240-01-15", "1/5/20245"]
    pairs = [(s, day) for s in same] + [(b, None) for b in bad]
    pairs += [("2024-12-31", dt.date(2024, 12, 31)), ("2024-02-29", dt.date(2024, 2, 29)), ("1/5/2024", dt.date(2024, 1, 5))]
    check(spark, pairs, lambda c: cells.to_date(c, AS_OF))


def test_two_digit_years(spark):
    pairs = [("01/15/25", dt.date(2025, 1, 15)), ("01/15/30", dt.date(2030, 1, 15)), ("01/15/99", dt.date(1999, 1, 15)),
             ("01/15/85", dt.date(1985, 1, 15)), ("1-15-99", dt.date(1999, 1, 15)), ("01.15.99", dt.date(1999, 1, 15)),
             ("02/29/72", dt.date(1972, 2, 29)), ("01/15/47", dt.date(1947, 1, 15)), ("01/15/46", dt.date(2046, 1, 15))]
    check(spark, pairs, lambda c: cells.to_date(c, AS_OF))


def test_to_bool(spark):
    pairs = [(w, True) for w in ("true", "TRUE", "t", "T", "yes", "Yes", "y", "1", " yes ")]
    pairs += [(w, False) for w in ("false", "FALSE", "f", "no", "No", "n", "0", "\tno\n")]
    pairs += [(w, None) for w in ("", "  ", "2", "maybe", "tru", "on")]
    check(spark, pairs, cells.to_bool)


def test_to_text(spark):
    check(spark, [("hello", "hello"), ("  hello ", "hello"), ("café", "café"), ("", None), ("   ", None), ("\t\t", None),
                  ("\n", None)], cells.to_text)


def test_clean_cell(spark):
    check(spark, [('="hello"', "hello"), ('="12345"', "12345"), ("=SUM(A1)", "SUM(A1)"), ('"hello"', "hello"),
                  ("'hello'", "hello"), ("\"hello'", "hello"), ("'12345", "12345"), ("netsuite:ABC123", "ABC123"),
                  ("NETSUITE:ABC123", "NETSUITE:ABC123"), (' ="test" ', "test"), ('""', ""), ("''", ""), ('="', ""),
                  ("", ""), ("  x ", "x"), ('="a\nb"', "a\nb"), ("==x", "=x"), ("' x '", " x ")], cells.clean_cell)


def test_uuid(spark):
    u = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    check(spark, [(u, u), (u.upper(), u), ("{" + u + "}", u), ("urn:uuid:" + u, u), (u.replace("-", ""), u), ("", None),
                  ("x" + u, None), (u[:-1], None)], cells.to_uuid)


def test_us_state(spark):
    check(spark, [("California", "CA"), ("new york", "NY"), (" TEXAS ", "TX"), ("ca", "CA"), ("Ca", "CA"),
                  ("District of Columbia", "District of Columbia"), ("DC", "DC"), (" Ontario ", "Ontario"), ("", "")],
          cells.normalize_us_state)


def test_ip_host(spark):
    check(spark, [("10.0.0.1:8080", "10.0.0.1"), ("10.0.0.1", "10.0.0.1"), ("[::1]:80", "::1"), ("::1", "::1"),
                  ("300.1.1.1", None), ("host:80", None), ("", None)], cells.ip_host)


def test_repair_utf8(spark):
    good = "café 你好".encode()
    cases = [(b"hello", "hello"), (b"he\x80lo", "he�lo"), (b"\xc3", "�"), (b"\xc0\x80", "��"),
             (b"\x80\x81\x82", "�" * 3), (b"\x93hi\x94", "�hi�"), (b"caf\xe9", "caf�"),
             (good, good.decode()), (b"\xe2\x82x", "��x"), (b"\xed\xa0\x80", "�" * 3), (b"", "")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "n int, b binary")
    text = F.col("b").cast("string")
    rows = df.select("n", cells.repair_utf8(text).alias("r"), cells.repair_utf8(text, "?").alias("q")).orderBy("n").collect()
    assert [r.r for r in rows] == [e for _, e in cases]
    assert [r.q for r in rows] == [e.replace("�", "?") for _, e in cases]


def test_fast_ways_agree_with_slow_ones(spark):
    odd = ["1٢", "+", "-", ".", "+.5", "-.5", "5.", "1.2.3", "/5", "1 2", "1d", "0x1", "1e5", "9E9", "12345678901234567890", "1" * 30, "+-1"]
    expected = [None, None, None, None, Decimal("0.5"), Decimal("-0.5"), Decimal(5), None, None, None, None, None, None, None, None, None, None]
    got = results(spark, odd, cells.to_numeric)
    assert got == expected
    days = ["2024-1--15", "202a-01-15", "+024-01-15", "2024-01-1 ", "2024-02-30", "0024-01-15", "1-15-24-99", "2024- 1-15"]
    assert results(spark, days, lambda c: cells.to_date(c, AS_OF)) == [None, None, None, None, None, dt.date(24, 1, 15), None, None]


def test_records_clean_like_single_cells(spark):
    pieces = ["x", "12", " 7 ", '="a"', "=b", "'c'", "netsuite:d", "\te", "f ", "3", "0", "1.50", "", "  ", "é", '" q "']
    records = [pieces[i : i + 4] for i in range(len(pieces))] + [["10", "21", "32", "43"], [" 0", "1 ", " 2 ", "3"]]
    df = spark.createDataFrame([(r,) for r in records], "t array<string>").withColumn("raw", F.array_join("t", ","))
    cleaned = cells.clean_record(F.col("raw"), F.col("t"))
    rows = df.withColumn("c", cleaned).withColumn("x", cells.trim_record(F.col("raw"), F.col("c"))).select(
        "t", "c", "x", F.transform("t", lambda c: cells.clean_cell(c)).alias("c1"), F.transform("c", lambda c: cells.trim(c)).alias("x1")
    )
    assert not [r for r in rows.collect() if r.c != r.c1 or r.x != r.x1]
