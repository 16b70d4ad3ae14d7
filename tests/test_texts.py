"""Text functions against hand-worked values."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loregrid.functions import arrow as ax
from loregrid.functions import text as tx


def one(spark, value, make):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(make(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "text,words",
    [("Hello, world! How are you?", "hello world how are you"), ("hello 123 world", "hello world"), ("café über straße", "café über straße"), ("foo-bar", "foobar"), ("", ""), ("  ", "")],
)
def test_tokenize(spark, text, words):
    assert one(spark, text, tx.tokenize) == words.split()


def test_index_tokens_keep_digits_and_long_bytes(spark):
    assert one(spark, "foo-bar 42 a é", tx.index_tokens) == ["foo", "bar", "42", "é"]


def test_null_text(spark):
    assert one(spark, None, tx.tokenize) is None
    assert one(spark, None, tx.is_garbage) is None
    assert one(spark, None, ax.normalize) is None


def test_stopwords(spark):
    tokens = F.array(*[F.lit(x) for x in "the cat is on a mat dem".split()])
    df = spark.createDataFrame([("en",), ("DE",), ("fr",), (None,)], "lang string")
    got = [r.k for r in df.select(tx.remove_stopwords(tokens, F.col("lang")).alias("k")).collect()]
    assert got[0] == ["cat", "mat", "dem"] and got[2] == got[0] and got[3] == got[0]
    assert "dem" in got[1] and "the" in got[1]


def test_jaccard(spark):
    df = spark.createDataFrame([("hello world", "hello"), ("", "")], "a string, b string")
    assert [r.j for r in df.select(tx.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.5, 0.0]


@pytest.mark.parametrize("text,n,grams", [("hello", 2, ["he", "el", "ll", "lo"]), ("hi", 5, ["hi"]), ("über", 2, ["üb", "be", "er"]), ("x", 0, []), ("", 2, [])])
def test_char_ngrams(spark, text, n, grams):
    assert one(spark, text, lambda c: tx.char_ngrams(c, n)) == grams


def test_normalize(spark):
    assert one(spark, "ﬁle ", ax.normalize) == "file"
    assert one(spark, "É", ax.normalize) == unicodedata.normalize("NFKD", "é")


def test_garbage(spark):
    assert one(spark, "�" * 10 + "ab", tx.is_garbage) is True
    assert one(spark, "" * 50, tx.is_garbage) is True
    assert one(spark, "An ordinary page of text.", tx.is_garbage) is False
    assert one(spark, "", tx.is_garbage) is False


def test_binary_verdict_on_empty(spark):
    assert one(spark, "", tx.is_binary) is True
    assert one(spark, "", lambda c: tx.is_binary(c, empty=False)) is False


@pytest.mark.parametrize(
    "text,clean",
    [
        ("eﬃcient and eﬀective oﬄine", "efficient and effective offline"),
        ("This is incor-\nporated into the system.", "This is incorporated into the system."),
        ("Hello   world.\t\tTest.\r\nLine.\n\n\n\n\nParagraph.", "Hello world. Test.\nLine.\n\nParagraph."),
        ("Some text here.\n42\nMore text.\n- 7 -\nEnd.", "Some text here.\nMore text.\nEnd."),
        ("Hello\x00\x01\x02 World\x0b\x0c test\nnewline", "Hello World test\nnewline"),
    ],
)
def test_clean_text(spark, text, clean):
    assert one(spark, text, ax.clean_text) == clean


def test_sentences():
    assert len(ax.split_sentences("Dr. Smith went to Washington. He met Prof. Jones there.")) == 2
    assert len(ax.split_sentences("The value is 3.14 approximately. That is correct.")) == 2
    assert len(ax.split_sentences("One. Two! Three?")) == 3
    assert ax.split_sentences("") == []
    assert len(ax.split_sentences("Wait... What happened? Nothing.")) == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 40))
def test_chunks_keep_bounds(text, longest):
    cut = ax.split_chunks(text, 1, longest, 0, "char")
    assert all(len(c) <= longest for c in cut)
    assert "".join(cut) == text.strip()


def test_chunks_overlap(spark):
    cut = ax.split_chunks("This is a test. This is another test.", 5, 20, 5, "sentence")
    assert len(cut) >= 2 and all(len(c) <= 20 for c in cut)
    with pytest.raises(ValueError):
        ax.chunks(F.lit("x"), longest=10, overlap=11)


@pytest.mark.parametrize(
    "heading,question",
    [
        ("Über uns", "Was kann man über  uns erfahren?"), ("About us", "What is us?"), ("FAQ:", "Welche häufigen Fragen gibt es zu FAQ?"),
        ("Kontakt", "Wie erreicht man Kontakt?"), ("What now?", "What now?"), ("How to win:", "How to win?"), ("Preise", "Was ist Preise?"),
    ],
)
def test_heading_question(spark, heading, question):
    assert one(spark, heading, tx.heading_question) == question


def test_truncate_never_cuts_a_character():
    assert ax.cut_at_sentence("é" * 300, 501) == "é" * 250 + "..."
    assert ax.cut_at_sentence("One. Two three", 8) == "One."
    assert ax.cut_at_sentence("one two three", 9) == "one two..."
    assert ax.cut_at_sentence("short", 9) == "short"


@pytest.mark.parametrize("text,theme,colour", [("Mach die Seite dunkel", "dark", None), ("Change to green background", None, "#44d7a8"), ("just talking", None, None)])
def test_intent(spark, text, theme, colour):
    r = one(spark, text, tx.settings_intent)
    assert (r.theme, r.colour) == (theme, colour) if r else (theme, colour) == (None, None)


def test_html(spark):
    page = "<title>T &amp; U</title><nav>menu</nav><p>One<p>Two <b>bold</b><input><script>x()</script><a href='/a'>l</a><a href='http://other/b'>o</a><a href='#f'>f</a>"
    df = spark.createDataFrame([(page, "http://host/x")], "p string, u string")
    r = df.select(ax.html_parts("p", "u").alias("h")).first().h
    assert r.title == "T & U" and r.text.split("\n") == ["One", "Two", "bold", "l", "o", "f"]
    assert r.links == ["http://host/a", "http://host/x#f"]


def test_jaro_winkler(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("help", "help"), ("a", None)], "a string, b string")
    got = [r.j for r in df.select(ax.jaro_winkler("a", "b").alias("j")).collect()]
    assert round(got[0], 4) == 0.9611 and got[1] == 1.0 and got[2] is None
