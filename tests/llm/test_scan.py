import numpy as np
import pytest

from folioframe.llm import scan

LINKS = {"surnrner": "summer", "1amp": "lamp", "m0dern": "modern", "rnodern": "modern"}


@pytest.fixture(scope="module")
def known():
    words = "the lamp modern captain answered summer lantern in attic and old governess corner am furnace well door".split()
    v = np.ones(2)
    lines = frozenset({"#- 0 -", "#— 0 —", "#第 0 页", "\t=thelonel", "\t=thelante"})
    return scan.Known(dict.fromkeys(words, 1000) | {"well-known": 500}, {a: (b, v) for a, b in LINKS.items()}, {"开丁门": "了"}, lines)


@pytest.mark.parametrize("text,want,kinds", [
    ("The mo-\ndern lamp", "The modern lamp", ["broken"]), ("the lan\xadtern", "the lantern", ["broken"]), ("the well-\nknown door", "the well-known door", []), ("The surnrner lamp", "The summer lamp", ["misread"]), ("the cap7ain", "the cap7ain", []),
    ("the 1amp and m0dern", "the lamp and modern", ["misread"]), ("the l a m p is", "the lamp is", ["spaced"]), ("old lamp\n- 12 -\nand door", "old lamp and door", ["furniture"]), ("old lamp\nThe Lonely Anchor · xii\nand door", "old lamp and door", ["furniture"]),
    ("old lamp\nand door", "old lamp and door", []), ("THE LANTERN SERIAL   141", "", ["furniture"]), ("— xiv —", "", ["furniture"]), ("Chapter 5", "Chapter 5", []), ("* * *", "* * *", []), ("第 16 页", "", ["furniture"]), ("J. R. R. Hill", "J. R. R. Hill", []),
    ("the sur-\n- 12 -\nnrner lamp", "the summer lamp", ["furniture", "broken", "misread"]), ("Some Other Book · xii", "Some Other Book · xii", []),
])
def test_repair(known, text, want, kinds):
    assert scan.repair_page(text, known) == (want, kinds)


def test_han(known):
    assert scan.correct_words("他打开丁门", known) == ("他打开了门", 1)


def test_pairs_of_glyphs_have_one_outline():
    for read, printed in [*scan.READ_AS.items(), *scan.PARTED.items(), *scan.CERTAIN.items()]:
        for p in printed.split():
            assert scan.outlines(f"x{read}x") & scan.outlines(f"x{p}x"), (read, p)
    for word in ("modern", "lantern", "summer", "closed", "window", "книга"):
        for v in scan.variants(word):
            assert scan.outlines(v) & scan.outlines(word), (word, v)


SENTENCES = ["the old captain answered in the modern lantern and the summer door", "a pale governess carried the heavy ladder over every bridge", "no guard had ever sold his bar at noon", "six cars of corn came down to the harbour", "her tall clerk never read one map twice"]


def corpus(spark, extra):
    rows = [("b", "c", i, SENTENCES[i % len(SENTENCES)]) for i in range(600)]
    return spark.createDataFrame(rows + extra, "book_id string, chapter_id string, block_index int, text string")


def repaired(df):
    got = scan.repair_pages(df, ["chapter_id", "block_index"], "text", "book_id").collect()
    return sorted((r["chapter_id"], r["block_index"], r["repaired"], tuple(r["kinds"])) for r in got)


def test_frame(spark):
    df = corpus(spark, [("b", "d", 0, "the old captain answered in the rnodern lantern"), ("b", "d", 0, "the old captain answered in the rnodern lantern"), ("b", "d", 1, None), ("b", "d", 2, ""), *(("b", "d", i, f"- {i} -") for i in (3, 4, 5))])
    assert repaired(df) == [("d", 0, "the old captain answered in the modern lantern", ("misread",))] * 2 + [("d", i, "", ("furniture",)) for i in (3, 4, 5)]
    assert scan.repair_pages(df.limit(0), ["chapter_id"], "text").count() == 0


def test_vectors_decide_which_words_are_misread(spark, monkeypatch):
    # 'cars' stands where ships and corn do, 'bar' where maps do: both are plausible readings of frequent words, but no neighbours of them.
    extra = [("b", "d", 0, "the old captain answered in the rnodern lantern"), ("b", "d", 1, "a pale govemess carried the heavy ladder"), ("b", "d", 2, "six ears of corn came down to the harbour"), ("b", "d", 3, "no guard had ever sold his har at noon")]
    df = corpus(spark, extra)
    found = {r[1] for r in repaired(df)}
    assert {0, 1} <= found
    learned = scan.learn_vectors
    monkeypatch.setattr(scan, "learn_vectors", lambda *a: None)
    assert repaired(df) == []  # without vectors no word is linked
    monkeypatch.setattr(scan, "learn_vectors", learned)
    monkeypatch.setattr(scan, "LEAST_COSINE", 1.01)
    assert repaired(df) == []


def test_headers_are_told_by_recurrence_in_their_book(spark):
    df = corpus(spark, [("b", "d", 0, "THE QUIET HARBOUR   12"), ("b", "d", 1, "The Quiet Harbour · xii"), ("q", "e", 0, "THE QUIET HARBOUR   12"), ("b", "d", 2, "A Number Of Things   7"), ("t", "f", 0, "Given Title   9")])
    assert {r[:2] for r in repaired(df)} == {("d", 0), ("d", 1)}
    titles = spark.createDataFrame([("t", "Given Title")], "book_id string, title string")
    got = scan.repair_pages(df, ["chapter_id", "block_index"], "text", "book_id", titles).collect()
    assert {(r["chapter_id"], r["block_index"]) for r in got} == {("d", 0), ("d", 1), ("f", 0)}


def test_filters_hold_every_key(spark):
    words = [f"w{i}" for i in range(3000)]
    bits = scan.filter_of(spark.createDataFrame([(w,) for w in words], "k string"), "k")
    assert scan._held(words, bits) == set(words) and len(scan._held([f"x{i}" for i in range(3000)], bits)) < 10
