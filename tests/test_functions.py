"""Scalar functions against plain Python."""

import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import codec, crc32_hex, delta_decode, delta_encode, extract_text, highlight, highlight_fields, levenshtein_bytes, normalize, occurrences, query_tokens, spaced, token_count, tokenize, varint_decode, varint_encode, varint_size
from siltstone.operators.hashing import spark_xxhash64

TEXTS = ["Hello, World!", "foo_bar-baz's", "  a\tb c\u0085d ", "", None, "ÜBER «quoted» 3.5", "...", "naïve café 東京"]


def test_tokenize(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", tokenize(F.col("t")).alias("k")).collect()}
    assert got[0] == ["hello", "world"] and got[1] == ["foo", "bar", "baz", "s"] and got[2] == ["a", "b", "c", "d"]
    assert got[3] == [] and got[4] is None and got[5] == ["über", "«quoted»", "3", "5"] and got[6] == []
    for i, t in enumerate(TEXTS):
        assert t is None or got[i] == query_tokens(t)


def test_counts_by_byte_searches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "the the The,the  there", "über-über"])], "i int, t string")
    normal = normalize(F.col("t"))
    got = df.select(tokenize(F.col("t")).alias("k"), token_count(normal).alias("n"), occurrences(spaced(normal), "the").alias("the"), occurrences(spaced(normal), "über").alias("u")).collect()
    for r in got:
        if r["k"] is not None:
            assert (r["n"], r["the"], r["u"]) == (len(r["k"]), r["k"].count("the"), r["k"].count("über"))
    assert got[-2]["the"] == 4 and got[-1]["u"] == 2


def test_extract_text(spark):
    df = spark.createDataFrame([("a", 3, 799.0, 1.5, True, ["x", "y"], None)], "s string, i int, d double, e double, b boolean, l array<string>, n string")
    assert df.select(extract_text(df.schema).alias("t")).first()["t"] == "a 3 799.0 1.5 true x y"
    v = spark.sql("""select parse_json(j) as v from values ('"hi"'), ('[1, "two", "three"]'), ('{"a": "b"}'), ('null'), ('true') as t(j)""")
    assert [r["t"] for r in v.select(extract_text(v.schema).alias("t")).collect()] == ["hi", "two three", "", "", "true"]


def test_highlight(spark):
    df = spark.createDataFrame([("The  (Bike), bikes BIKE!",), ("",), ("  ",), (None,)], "t string")
    got = [r["h"] for r in df.select(highlight(F.col("t"), ["bike"]).alias("h")).collect()]
    assert got == ["The <em>(Bike),</em> bikes <em>BIKE!</em>", "", "  ", None]
    assert [r["h"] for r in df.select(highlight(F.col("t"), []).alias("h")).collect()][0] == "The  (Bike), bikes BIKE!"
    two = spark.createDataFrame([("a  b", "same")], "x string, y string")
    assert two.select(highlight_fields(["x", "y"], ["zzz"]).alias("h")).first()["h"] == {"x": "a b"}  # white space changed


def test_levenshtein(spark):
    df = spark.createDataFrame([("über", "uber"), ("kitten", "sitting"), ("", "abc"), (None, "x")], "a string, b string")
    assert [r["d"] for r in df.select(levenshtein_bytes(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 3, 3, None]


def test_codecs(spark):
    lists = [[], [0], [5, 5, 9, 300, 1 << 40]]
    df = spark.createDataFrame([(v,) for v in lists], "v array<bigint>")
    back = df.select(delta_decode(delta_encode(F.col("v"))).alias("d"), delta_encode(F.col("v")).alias("g"), varint_decode(varint_encode(F.col("v"))).alias("w")).collect()
    assert [r["d"] for r in back] == lists and [r["w"] for r in back] == lists and back[2]["g"] == [5, 0, 4, 291, (1 << 40) - 300]
    sizes = spark.createDataFrame([(0,), (127,), (128,), (16384,)], "x bigint").select(varint_size(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in sizes] == [1, 1, 2, 3]
    gaps = codec.encode_varint([1] * 1000)
    assert len(gaps) < 0.25 * 8 * 1000  # consecutive ids
    for bad in (b"\x80", b"\xff" * 9 + b"\x02"):
        with pytest.raises(ValueError):
            codec.decode_varint(bad)
    for bad in (-1, 1 << 64):
        with pytest.raises(ValueError):
            codec.encode_varint([bad])


@settings(max_examples=50, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, (1 << 64) - 1)))
def test_varints_round_trip(values):
    assert codec.decode_varint(codec.encode_varint(values)) == values


def test_hashes(spark):
    df = spark.createDataFrame([("the",), ("über",), ("",)], "t string")
    for r in df.select("t", F.xxhash64("t").alias("h"), crc32_hex(F.col("t")).alias("c")).collect():
        assert spark_xxhash64(r["t"].encode()) == r["h"] and r["c"] == f"{zlib.crc32(r['t'].encode()):08x}"
