"""Functions held against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,n", [("Hello world (foo)?", 3), ("well-known e.g. 3.14 a/b --", 7), ("--abc d-e 3-4 a1-b- 'x' (?)", 6), ("", 0), (" a。b", 2)])
def test_word_count(spark, text, n):
    assert one(spark, text, T.count_words) == n


def test_ideographs(spark):
    assert one(spark, "漢字。ab cd", T.count_ideographs) == 4
    assert one(spark, "😀", T.count_ideographs) == 2
    assert one(spark, "😀a", T.utf16_length) == 3


@pytest.mark.parametrize("text,words,ideographs", [("..b-5.x (a.b) .-.", 3, 3), ("漢a.b漢5 x漢.漢y介介ß", 4, 8), ("a漢b。٣.٤！𝟗.𝟗-z", 3, 9), ("\n.\u00a0-x", 1, 1), (None, 0, None)])
def test_words_between_marks(spark, text, words, ideographs):
    assert one(spark, text, T.count_words) == words
    assert one(spark, text, T.count_ideographs) == ideographs


def test_words_are_counted_in_one_pass(spark):
    """No array of tokens, each of which is searched again by interpreted lambdas."""
    x = spark.createDataFrame([("a",)], "x string").select(T.count_words(F.col("x")).alias("w"), T.count_ideographs(F.col("x")).alias("i"))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "split(" not in plan


@pytest.mark.parametrize("qualities,kind", [(["100"], "exact"), (["99"], "95"), (["84"], "75"), (["49"], "new"), (["101"], "new"), (["98.5"], "new"), ([], "new"), (["x", "60"], "50")])
def test_match_class(spark, qualities, kind):
    assert spark.createDataFrame([(qualities,)], "q array<string>").select(T.match_class(F.col("q"))).first()[0] == kind


def test_normalise(spark):
    assert one(spark, " a  \n\n b\tc ", T.normalise) == "a b\tc"
    assert one(spark, "aeiouAEIOU x", T.pseudo) == "áèîöúÁÈÎÖÚ x"


@pytest.mark.parametrize("text,h", [("", 0), ("a", 97), ("hello", 99162322), ("some/x.properties", None), ("polygenelubricants", -2147483648)])
def test_java_hash(spark, text, h):
    if h is None:
        h = 0
        for c in text:
            h = (31 * h + ord(c)) & 0xFFFFFFFF
        h -= (h >= 1 << 31) << 32
    assert one(spark, text, T.java_hash) == h


@pytest.mark.parametrize("text,ok", [("2024-02-29T00:00:00Z", True), ("2023-02-29T00:00:00Z", False), ("2024-01-01", False), ("2024-01-01T25:00:00Z", False)])
def test_date(spark, text, ok):
    assert one(spark, text, T.is_date) is ok


@pytest.mark.parametrize("tag,ok", [("en", True), ("en-US", True), ("zh-Hant-TW", True), ("x-klingon", True), ("x-a-", False), ("EN", False), ("e", False)])
def test_language(spark, tag, ok):
    assert one(spark, tag, T.is_language) is ok


def test_small_ones(spark):
    assert one(spark, "a %d of %% and %5.2f", T.printf_parameters) == ["%d", "%5.2f"]
    assert [one(spark, x, T.is_number_cell) for x in ("12", "$ 1,200.50", "50 %", "a1", "")] == [True, True, True, False, False]
    assert [one(spark, x, T.is_ncname) for x in ("a-b.1", "_x", "1a", "a b")] == [True, True, False, False]
    assert one(spark, "é中\n", T.escape_unicode) == "é\\u4e2d\\n"
    assert one(spark, "a=1;b=22;", T.parse_status) == {"a": 1, "b": 22}
    assert one(spark, "x<b>y</b> 1 < 2", T.split_tags) == ["x", "<b>", "y", "</b>", " 1 < 2"]
    tokens = one(spark, "x<b>y</b>", T.tag_tokens)
    assert [(t["kind"], t["id"], t["text"]) for t in tokens] == [("text", None, "x"), ("ph", "1", "<b>"), ("text", None, "y"), ("ph", "2", "</b>")]


def test_tag_penalty(spark):
    df = spark.createDataFrame([("a<b>x</b>", "a<b>x"), ("a", "a"), ("<i>a", "<b>a")], "a string, b string")
    got = [r[0] for r in df.select(T.tag_penalty(T.tag_tokens(F.col("a")), T.tag_tokens(F.col("b")), 3)).collect()]
    assert got == [3, 0, 3]
