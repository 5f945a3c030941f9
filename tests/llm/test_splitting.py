import random

import pytest

from folioframe.llm import splitting


def test_pieces_tile_with_overlap_under_the_limit():
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice(["word ", "End. ", "\n\n", "x", "字。", "\r\n", "é́", "   "]) for _ in range(random.randint(0, 300)))
        limit = random.randint(5, 120)
        overlap = random.randint(0, limit - 1) if random.random() < 0.7 else 0
        got = splitting.split(text, limit, overlap)
        if not text:
            assert got == []
            continue
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 < e - s <= limit for s, e in got)
        assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(got, got[1:]))
        assert "".join([text[got[0][0] : got[0][1]], *(text[s + overlap : e] for s, e in got[1:])]) == text


def test_cuts_at_the_strongest_boundary_near():
    text = "a" * 40 + ". " + "b" * 10 + "\n\n" + "c" * 50
    assert splitting.split(text, 80)[0][1] == 54


def test_bad_limits():
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            splitting.split("x", *bad)


def frames(spark):
    limits = spark.createDataFrame([("chapter_blocks", "chars", 50, 10), ("tiny", "chars", 20, 5), ("t", "tokens", 5, 0)], "limit_id string, unit string, max_size int, overlap_size int")
    blocks = [("c1", i, f"Block {i} has words. ") for i in range(60)] + [("c1", 3, "Block 3 has words. "), ("c1", 60, None), ("c2", 0, "short"), ("c3", 0, "x" * 400), ("c4", 0, None)]
    return limits, spark.createDataFrame(blocks, "chapter_id string, block_index int, text string")


@pytest.mark.parametrize("run", [120, 1 << 18])
def test_blocks(spark, run):
    limits, blocks = frames(spark)
    got = splitting.split_blocks(blocks, limits, "chapter_blocks", "chapter", "chapter_id", "block_index", "text", run)
    assert sorted(tuple(r) for r in splitting.oversized(got).collect()) == [("chapter", "c1"), ("chapter", "c3")]
    whole = {"c1": "".join(f"Block {i} has words. " for i in range(60)), "c3": "x" * 400}
    for c, text in whole.items():
        ps = sorted(got.filter(f"item_id = '{c}'").collect(), key=lambda r: r["start_char"])
        assert all(text[r["start_char"] : r["end_char"]] == r["text"] and len(r["text"]) <= 50 for r in ps)
        assert ps[0]["start_char"] == 0 and ps[-1]["end_char"] == len(text) and all(b["start_char"] == a["end_char"] - 10 for a, b in zip(ps, ps[1:]))


def test_rows(spark):
    limits, _ = frames(spark)
    df = spark.createDataFrame([("a", "tiny", "one two three four five six"), ("a", "tiny", "one two three four five six"), ("b", "tiny", None), ("c", "none", "x" * 99), ("d", "tiny", ""), ("e", "t", "x" * 99)], "context_id string, limit_id string, current_chapter string")
    got = splitting.split_rows(df, limits, "context", "context_id", "current_chapter")
    assert {r["item_id"] for r in got.collect()} == {"a"} and got.count() == got.select("piece_index").distinct().count()
    assert splitting.split_rows(df.limit(0), limits, "context", "context_id", "current_chapter").count() == 0
