import pytest
from helpers import rows
from pyspark.sql import functions as F

from almanac.functions.names import clean_name, repeat_suffix, unique_names
from almanac.functions.text import RESERVED_WORDS, ascii_text, clean_text, number_text, number_value, strip_accents, word_set
from almanac.operators import columns as C


def test_unique_names():
    assert unique_names(["a", "A", "a", "b"]) == ["a", "Ab", "ac", "b"]
    assert unique_names(["a", "A", "a"], nocase=False) == ["a", "A", "ab"]
    assert unique_names(["ab", "a", "a"]) == ["ab", "a", "ac"]
    assert [repeat_suffix(i) for i in (1, 25, 26, 27)] == ["b", "z", "za", "zb"]


@pytest.mark.parametrize(
    "raw, level, want",
    [
        ("(b)", 1, "b"),
        ("x-y z", 1, "x_y_z"),
        ('"q";:', 1, "q"),
        ("p&q", 1, "pandq"),
        ("é", -1, "e"),
        ("it's", 1, "it''s"),
        ("it''s", 0, "it''s"),
        ("it's", 0, "it''s"),
        ("a b", 0, "a b"),
        ("my select col", 2, "my_SELECTcol"),
        ("select col", 2, "select_col"),
        ("ß日", 1, ""),
    ],
)
def test_clean_same_in_both_forms(spark, raw, level, want):
    assert clean_name(raw, level) == want
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(clean_text(F.col("s"), level)).first()[0] == want


def test_clean_options(spark):
    df = spark.createDataFrame([("Ab C",), (None,)], "s string")
    assert rows(df.select(clean_text(F.col("s"), 1, lower=True, length=3))) == [("ab_",), (None,)]
    assert clean_name("Ab C", 1, True, 3) == "ab_"
    with pytest.raises(ValueError):
        clean_name("a", 3)
    assert len(RESERVED_WORDS) == len(set(RESERVED_WORDS))


def test_accents_for_all_characters(spark):
    """The character map equals decomposition, character by character."""
    chars = [chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000] + ["𝐀", "Å", "K"]
    df = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(chars)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", strip_accents(F.col("s")).alias("t")).collect()}
    assert [i for i, c in enumerate(chars) if got[i] != ascii_text(f"x{c}y")] == []


def test_positions_with_repeated_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("k", "k", "v")
    assert rows(C.select_cols(df, [1, "v"])) == [(2, 3)]
    assert C.reorder(df, [2, 0, 1, 2]).columns == ["v", "k", "k", "v"]
    assert rows(C.drop_columns(df, [0])) == [(2, 3)]
    assert rows(C.move_to_index(df, -1, 0)) == [(3, 1, 2)]
    assert C.unique_header(df).columns == ["k", "kb", "v"]
    assert C.rename_header(df, ["x", ""]).columns == ["x", "k", "v"]
    assert C.default_header(df).columns == ["_field_0", "_field_1", "_field_2"]
    assert rows(C.dimensions(df)) == [(3, 1)]
    assert rows(C.flatten_values(df)) == [(0, "k", "1"), (1, "k", "2"), (2, "v", "3")]
    with pytest.raises(KeyError):
        C.select_cols(df, ["none"])
    with pytest.raises(IndexError):
        C.select_cols(df, [3])


def test_headers(spark):
    df = spark.createDataFrame([(1,) * 8], [f"c{i}" for i in range(8)]).toDF("a", "A", "a", "(b)", "x-y", '"q"', "p&q", "é")
    assert C.clean_header(df).columns == ["a", "Ab", "ac", "b", "x_y", "q", "pandq", "e"]


def test_add_constants(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert C.add_constants(df, {"x": "v", "n": None}).columns == ["x", "n", "a"]
    assert rows(C.add_constants(df, {"x": "v"}, front=False)) == [(1, "v")]


def test_concat_columns(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(20,), (10,)], "k int")
    assert rows(C.concat_columns(a, b, ["k"], ["k"])) == [(1, "a", 10), (2, "b", 20), (3, "c", None)]
    assert C.concat_columns(a, b, ["k"], ["k"]).columns == ["k", "v", "kb"]


def test_number_texts(spark):
    data = [("1,234",), (" 007 ",), ("12.50",), ("x, y ",), ("",), ("  ",), (None,), ("1e3",), ("-5",), ("nan",)]
    df = spark.createDataFrame(data, "s string")
    text = [r[0] for r in df.select(number_text(F.col("s"))).collect()]
    assert text == ["1234", "7", "12.50", "x y", None, None, None, "1e3", "-5", "nan"]
    value = [r[0] for r in df.select(number_value(F.col("s"))).collect()]
    assert value == [1234.0, 7.0, 12.5, None, None, None, None, 1000.0, -5.0, None]


def test_word_set(spark):
    df = spark.createDataFrame([("  The cat, the DOG!",), ("",), (None,), ("don't",)], "s string")
    assert [r[0] for r in df.select(word_set(F.col("s"))).collect()] == [["cat", "dog", "the"], [], [], ["dont"]]
