import os
import random

import pytest

from folioframe.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary file")


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder()


def texts():
    random.seed(2)
    out = ["", "plain words here", "<|endoftext|>", "a" * 5000, "你好" * 900, " \t\n" * 700, "x" * 300 + "'ll" + "y" * 900, "né́ 🙂" * 200, "0123456789" * 300]
    for alphabet in ("ab", "aab b\n", "你好吗a", "é ü\t x", ". !-a", "the and in "):
        out += ["".join(random.choice(alphabet) for _ in range(random.randint(1, 4000))) for _ in range(8)]
    return out


def test_tree_equals_direct_encoding(enc):
    for t in texts():
        assert enc.encode(t) == enc.plain(t)
    assert enc.encode(None) == []


def test_against_the_other_library(enc):
    from tokenizers import Tokenizer

    path = tokens.TOKENIZER.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no second file")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for x in texts():
        assert enc.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_frame(spark, enc):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, "twice"), (901, "twice"), (None, "no key")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    for spread in (1 << 20, 500):
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), list(r["ids"])) for r in tokens.encode_corpus(df, spread_chars=spread, leaf_chars=257).collect())
        assert got == sorted(((k is None, k or 0), enc.plain(t or "")) for k, t in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def check_packing(rows, sizes, cap):
    load, parts = {}, {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part_index"], r["start_token"], r["n_tokens"]))
    assert max(load.values()) <= cap and set(parts) == set(sizes)
    for d, ps in parts.items():
        ps.sort()
        assert sum(n for *_, n in ps) == sizes[d] and [s for _, s, _ in ps] == [sum(n for *_, n in ps[:i]) for i in range(len(ps))]
        assert len(ps) == 1 or sizes[d] > cap
    return sum(load.values()) / (cap * len(load))


def test_packing(spark, enc):
    random.seed(4)
    docs = [(i, " word" * random.randint(0, 70)) for i in range(600)] + [(1000, None), (1001, " word" * 350), (1002, "")]
    limits = spark.createDataFrame([("a", 100), ("b", 40)], "limit_id string, max_size int")
    got = packing.pack_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), limits, windows=8).collect()
    for name, cap in (("a", 100), ("b", 40)):
        fill = check_packing([r for r in got if r["limit_id"] == name], {i: len(enc.encode(t)) for i, t in docs}, cap)
        assert fill > 0.9
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_texts(empty, limits).count() == 0
