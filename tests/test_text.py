import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioframe.functions import ids, spans, text
from folioframe.operators.context import estimate


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("value,n", [("Hello, world! It's 2026.", 4), ("你好，世界", 4), ("élan vital", 2), ("", 0), (None, 0), ("rock 'n' roll", 3)])
def test_words(spark, value, n):
    assert one(spark, value, text.count_words) == n


@pytest.mark.parametrize("value,n", [("hello world", 4), ("你好世界", 4), ("hello，你好", 5), ("", 0), (None, 0), ("áb", 3)])
def test_tokens(spark, value, n):
    assert one(spark, value, text.estimate_tokens) == n
    assert estimate(value or "") == n


@pytest.mark.parametrize("line", ["Chapter One", "CHAPTER 12: The End", "part iv — x", "Prologue", "第十二章 风", "序章", "Chapter house"])
def test_headings(spark, line):
    assert one(spark, f"  {line}\t", text.heading) == line


@pytest.mark.parametrize("line", ["Chapter house on the hill", "A chapter", "第章", "", "   "])
def test_no_headings(spark, line):
    assert one(spark, line, text.heading) is None


def test_normalize(spark):
    assert one(spark, "﻿Café\r\nNext\rLast", text.normalize) == "Café\nNext\nLast"
    assert one(spark, "　 a  ", text.trimmed) == "a"
    assert one(spark, " a\n\n b ", text.simplified) == "a b"
    assert one(spark, None, text.normalize) is None


@pytest.mark.parametrize("line,yes", [("***", True), (" * * * ", True), ("---", True), ("# # #", True), ("**", False), ("----", False)])
def test_scene_break(spark, line, yes):
    assert one(spark, line, text.is_scene_break) is yes


def test_stable_ids(spark):
    want = "book_" + hashlib.sha256(b"book\0a/b.txt").hexdigest()[:32]
    assert one(spark, "a/b.txt", lambda c: ids.stable_id("book", c)) == want
    assert one(spark, want, lambda c: ids.is_stable_id("book", c)) is True
    assert one(spark, "book_1", lambda c: ids.is_stable_id("book", c)) is False
    with pytest.raises(ValueError):
        ids.stable_id("pet", F.lit("x"))


def test_canonical_json():
    assert ids.canonical_json({"b": 1.0, "a": ["é", 1.5, None]}) == '{"a":["é",1.5,null],"b":1}'


@pytest.mark.parametrize("value", ["", "aa", "é, b,c,,d 你,", "x" * 5000 + ",y" * 700])
def test_match_spans(spark, value):
    got = one(spark, value, lambda c: spans.match_spans(c, r",+"))
    want = [(len(value[: m.start()].encode()), m.group()) for m in re.finditer(",+", value)]
    assert [(x["start"], x["text"]) for x in got] == want


def test_match_spans_zero_width_and_null(spark):
    assert [x["start"] for x in one(spark, "é,b;c", lambda c: spans.match_spans(c, r"(?<=[,;])(?=\p{L})"))] == [3, 5]
    assert one(spark, None, lambda c: spans.match_spans(c, "a")) is None


def test_span_predicates(spark):
    f = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    n = [F.lit(i) for i in range(10)]
    assert f(spans.overlaps(n[0], n[5], n[4], n[6])) and not f(spans.overlaps(n[0], n[5], n[5], n[6]))
    assert f(spans.touches(n[5], n[5], n[5], n[9])) and not f(spans.touches(n[4], n[5], n[5], n[9]))
    assert not f(spans.contains(n[3], n[3], n[3], n[3])) and f(spans.contains(n[1], n[4], n[4], n[4]))
    assert f(spans.protects(n[2], n[6], n[4], n[4])) and not f(spans.protects(n[2], n[6], n[6], n[6]))
    assert f(spans.byte_slice(F.lit("aéb"), F.lit(1), F.lit(3))) == "é" and f(spans.byte_slice(F.lit("aéb"), F.lit(1), F.lit(2))) is None


def test_meaningful_terms(spark):
    f = lambda q, t: spark.range(1).select(text.contains_meaningful_term(F.lit(q), F.lit(t)).alias("x")).first()["x"]
    assert f("The Lantern burns", "lantern") and f("old Garquist came", "Mr Garquist") and f("灯笼", "灯")
    assert not f("an ox", "ox") and not f("abc", "") and not f("nothing", "Mr Bo")


def test_nfc_matches_python(spark):
    rows = ["é", "ﬁ", "가", "plain"]
    got = [r["x"] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.nfc(F.col("t")).alias("x")).collect()]
    assert got == [unicodedata.normalize("NFC", r) for r in rows]
