import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgforge.functions import documents, keys, text, values


def one(spark, column, **given_):
    return spark.createDataFrame([tuple(given_.values())], ", ".join(f"{k} string" for k in given_)).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("raw", "out"), [("12", 12), ("+12", 12), ("1.234.567", 1234567), ("1 234", 1234), ("1_000", 1000), ("1.23.4", None), ("1,234.567", None), ("x", None), ("", None), (None, None), ("null", None)])
def test_integers(spark, raw, out):
    assert one(spark, values.normalize_integer(F.col("raw")), raw=raw) == out


@pytest.mark.parametrize(("raw", "out"), [("1,234", 1.234), ("1.234.567,8", 1234567.8), ("1,234,567.8", 1234567.8), ("1e3", 1000.0), ("-2.5E-1", -0.25), ("1,234,567", 1234567.0), ("1.2.3", None), ("1,234,5", None), ("null", None)])
def test_floats(spark, raw, out):
    assert one(spark, values.normalize_float(F.col("raw")), raw=raw) == out


@pytest.mark.parametrize(("raw", "out"), [("29/02/2024", "2024-02-29"), ("29/02/2023", None), ("05/06/2020", "2020-06-05"), ("12.31.1999", "1999-12-31"), ("marzo de 2024", "2024-03"), ("3º de enero de 1980", "1980-01-03"), ("Foo 2024", None), ("24-01-01", None), ("0000", None)])
def test_dates(spark, raw, out):
    assert one(spark, values.normalize_date(F.col("raw")), raw=raw) == out


def test_unreadable(spark):
    rows = spark.createDataFrame([("x", None), (" NULL ", None), ("3", 3), (None, None)], "raw string, v int")
    assert [r[0] for r in rows.select(values.unreadable(F.col("raw"), F.col("v"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize(("raw", "out"), [("  Straße 12–14 ", "strasse 12-14"), ("a\nb", "ab"), ("(x)", "x"), ("Łódź", "lodz"), ("///", None), ("C++", "c++"), ("ＡＢ", "ab"), ("", None), (None, None), ("é" * 3 + "  b", "eee b")])
def test_keys(spark, raw, out):
    assert one(spark, keys.normalize_pk(F.col("raw")), raw=raw) == out


@given(st.text(st.characters(min_codepoint=32, max_codepoint=126)))
def test_plain_keys_agree_with_python(raw):
    pattern = re.sub(r"[^a-z0-9\s/\-+_#&@.:()]", "", raw.lower())
    assert keys.normalize(raw) == (re.sub(r"\s+", " ", re.sub(r"^[\s/\\.:()]+|[\s/\\.:()]+$", "", pattern)) or None)


@given(st.text())
def test_unescape_undoes_escape_of_letters(raw):
    escaped = raw.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    assert text.unescape_text(escaped) == raw


def test_escape_of_controls(spark):
    assert one(spark, text.escape(F.col("x")), x="a\x01\x7f\n\\") == "a\\u0001\\u007f\\n\\\\"


def test_normalize_text(spark):
    assert one(spark, text.normalize_text(F.col("x")), x="a\r\nb\rc\u2028d\u2029e f\x00g") == "a\nb\nc\nd\ne fg"


def test_decode_utf8(spark):
    rows = spark.createDataFrame([(b"\xef\xbb\xbfab",), (b"\xff\xfe",), (b"",)], "c binary")
    assert [r[0] for r in rows.select(text.decode_utf8(F.col("c"))).collect()] == ["ab", None, ""]


@pytest.mark.parametrize(("said", "out"), [('{"a": 1}', '{"a": 1}'), ('Here: {"a": [1]} and {"b": 2}', '{"a": [1]}'), ("[oops {\"a\": 1}", '{"a": 1}'), ("prose", None), ('{"a": ', None)])
def test_first_json(said, out):
    assert documents.first_json(said) == out


def test_items_and_singletons(spark):
    rows = spark.createDataFrame([('{"items": [{"a": 1}, 2, {"a": 3}]}',), ('[{"a": 5}]',), ('{"items": 4}',)], "s string").select(F.parse_json("s").alias("v"))
    assert [r[0] for r in rows.select(F.size(documents.items_of(F.col("v"), "items"))).collect()] == [2, 1, None]
    lists = spark.createDataFrame([("[7]",), ("[7, 8]",), ("7",)], "s string").select(documents.unwrap_singleton(F.parse_json("s")).cast("string").alias("out"))
    assert [r[0] for r in lists.collect()] == ["7", "[7,8]", "7"]


@pytest.mark.parametrize(("word", "out"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("adjustment", "adjust"), ("generalizations", "gener")])
def test_stems(word, out):
    assert keys.stem(word) == out


@pytest.mark.parametrize(("raw", "key"), [
    ("Москва", "moskva"), ("Київ 2", "kiyiv 2"), ("Αθήνα", "athena"), ("Ψυχή", "psukhe"), ("Straße", "strasse"), ("Ærø", "aero"), ("Łódź", "lodz"), ("Щука", "shchuka"), ("東京", "u6771u4eac"), ("とうきょう", "toukiyou"), ("한글", "hangeul"),
    ("Çelik  —  İş", "celik - is"), ("٣ بيت", "3 behyehteh"), ("½ año", "12 ano"), ("///", None), ("  ", None), ("💡", None), ("A\x00B", "ab"), ("日本", "u65e5u672c"),
])
def test_keys_of_all_scripts(raw, key):
    assert keys.normalize(raw) == key


def test_no_key_loses_its_letters(spark):
    letters = ["ж", "ω", "ა", "א", "ن", "क", "漢", "ア", "ก", "ሀ"]
    rows = spark.createDataFrame([(f"{c} 1",) for c in letters], "raw string")
    found = [r["k"] for r in rows.select(keys.normalize_pk(F.col("raw")).alias("k")).collect()]
    assert len(set(found)) == len(letters) and all(k and k != "1" and k.isascii() for k in found)


def test_responses_of_many_brackets_take_little_time(spark):
    began = time.perf_counter()
    deep = ["[" * 100_000, "{" * 100_000, "[" * 50_000 + "]" * 50_000, '{"a' * 30_000, "[" * 100_000 + ' {"x": 1}', '["' * 30_000, "so: [1, 2] and {}"]
    assert [documents.first_json(t) for t in (deep[0], deep[1], deep[3], deep[5])] == [None] * 4 and documents.first_json(deep[4]) == '{"x": 1}' and documents.first_json(deep[6]) == "[1, 2]"
    got = spark.createDataFrame([(t,) for t in deep], "t string").select(documents.decode_response(F.col("t")).cast("string").alias("v")).collect()
    assert [r["v"] for r in got][4:] == ['{"x":1}', None, "[1,2]"] and time.perf_counter() - began < 30


def test_numbers_and_dates_in_all_their_forms(spark):
    numbers = {"1,234": (1234, 1.234), "1.234.567": (1234567, 1234567.0), "1 234,5": (None, 1234.5), "1_000": (1000, 1000.0), "12,34": (None, 12.34), "1,23,456": (None, None), "-7": (-7, -7.0), "+1.234,5e2": (None, 123450.0), "1e5": (None, 1e5), "5.": (None, None), "1,234.5,6": (None, None), "--1": (None, None)}
    rows = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", values.normalize_integer(F.col("t")).alias("i"), values.normalize_float(F.col("t")).alias("f")).collect()
    assert {r["t"]: (r["i"], r["f"]) for r in rows} == numbers
    dates = {"2021": "2021", "2021-3": "2021-03", "3.2021": "2021-03", "2021/03/09": "2021-03-09", "9/3/2021": "2021-03-09", "3/14/2021": "2021-03-14", "2021/3-9": None, "9 March 2021": "2021-03-09", "9th of march, 2021": "2021-03-09", "march 9, 2021": "2021-03-09", "1º de enero de 2021": "2021-01-01", "sept. 2021": "2021-09", "foo 2021": None, "31/2/2021": None, "june of 9 2021": None}
    rows = spark.createDataFrame([(t,) for t in dates], "t string").select("t", values.normalize_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == dates
