"""Text functions on cases that the tables lack."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import markup
from weftline.functions import text as tx


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(("given", "want"), [("a\r\nb\rc", "a\nb\nc"), ("a​b c", "abc"), ("\x00a\x07\x7f\tb", "a\tb"), ("a‍b c", "a‍b c"), ("", "")])
def test_normalize(spark, given, want):
    assert one(spark, tx.normalize(F.col("t")), given) == want


@pytest.mark.parametrize(("given", "want"), [("a\n\n \t\nb", "a\nb"), ("a\n  ", "a"), ("\n\na", "a"), ("Line one\n\n\n\n\n\n\nLine two\n\n\nLine three", "Line one\nLine two\nLine three")])
def test_strip_empty(spark, given, want):
    assert one(spark, tx.strip_empty(F.col("t")), given) == want
    assert one(spark, tx.clean_output(F.col("t"), True, True), given) == want


def test_double_newlines(spark):
    assert one(spark, tx.double_newlines(F.col("t")), "a\nb\n\n\nc") == "a\n\nb\n\nc"


def test_template(spark):
    t = F.lit("{{ .A }}-{{.B}}-{{ .C }}")
    assert one(spark, tx.fill_template(t, {"A": F.lit("{{ .B }}"), "B": F.lit("$1\\")})) == "{{ .B }}-$1\\-{{ .C }}"
    assert one(spark, tx.fill_template(F.lit(""), {"A": F.lit("x")})) == ""
    assert one(spark, tx.fill_languages(F.lit("{{ .LanguageSource}} to {{.LanguageTarget }}"), F.lit("a$b"), F.lit("c"))) == "a$b to c"


@pytest.mark.parametrize(("path", "want"), [("/a/b.tar.gz", "btar"), ("日本語 テキスト.txt", "日本語テキスト"), ("x" * 40, "x" * 28), ("a" * 27 + "𝒳b", "a" * 27), ("!!.txt", "")])
def test_session_fragment(spark, path, want):
    assert one(spark, tx.session_fragment(F.col("t")), path) == want


def test_lengths_and_tokens(spark):
    assert one(spark, tx.graphemes(F.col("t")), "👨‍👩‍👧é") == 2
    assert one(spark, tx.utf16_length(F.col("t")), "a🙂") == 3
    assert one(spark, tx.approximate_tokens(F.col("t")), "日本ab12🙂") == 10
    assert one(spark, tx.approximate_tokens(F.col("t")), "") == 0


def test_delimiters(spark):
    assert one(spark, tx.extract_tagged(F.col("t"), "[", "]"), "[ a ]x[]y[ \n ]") == "a\n\n"
    assert one(spark, tx.delete_tagged(F.col("t"), "(*", "*)"), "a(* b\nc *)d") == "ad"
    assert one(spark, tx.strip_fence(F.col("t")), '```json\n{"a":1}\n```') == '{"a":1}'


def test_markdown():
    assert markup.plain_text("# Title\n\nSome **bold** [link](u) `code`\n\n3. a\n9. b\n* c") == "Title\n\nSome bold link code\n\n3. a\n4. b\n\n- c"
    assert markup.plain_text("| a | b |\n|---|:-:|\n| c | d |") == "a | b\nc | d"
    assert markup.plain_text("a \\*b\\* c\n\n\n\nd") == "a *b* c\n\nd"
    assert markup.plain_text("#nospace") == ""


def test_width_and_wrap():
    assert markup.display_width("ab\x1b[31mc\x1b[0m") == 3
    assert markup.display_width("日本é") == 5
    assert markup.display_width("👨‍👩‍👧") == 2
    assert markup.wrap("") == []
    assert markup.wrap("aaa bbb ccc", 7) == ["aaa bbb", "ccc"]
    assert markup.wrap("abcdefghij", 4) == ["abcd", "efgh", "ij"]


def test_fast_hash():
    assert markup.fast_hash("") == markup.fast_hash("")
    assert len({markup.fast_hash(f"k{i}") for i in range(5000)}) == 5000
    assert int(markup.fast_hash("𝒳 text"), 16) < 2**53
