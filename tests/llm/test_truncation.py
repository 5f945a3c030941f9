import random

from folioframe.llm import truncation


def sentence(rng):
    return f"The {rng.choice(['old', 'tall', 'pale'])} {rng.choice(['tailor', 'guard', 'clerk'])} {rng.choice(['kept', 'lost', 'sold'])} {rng.randint(1, 9999)} coins near {rng.choice('abcdefgh') * 3} hill."


def test_spikes_and_endings(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(900):
        body = " ".join(sentence(rng) for _ in range(rng.randint(3, 9)))
        if i % 3 == 0:  # a field of 200 characters
            kind, text = "field", body[:200]
            if len(body) > 200 and not text.rstrip().endswith("."):
                want.add(i)
        elif i % 3 == 1:
            kind, text = "free", body + rng.choice(["", "", "\n\n— Ada Hill, night desk", "\n\nTHE END", "\n* one lamp\n* two doors", " “You never—”"])
        else:
            kind, text = "cards", body if len(body) <= 177 else body[:177] + "..."
            if text.endswith("...") and not body[:177].rstrip().endswith("."):
                want.add(i)
        rows.append((i, text, kind))
    rows += [(2000, None, "free"), (2001, "", "free"), (2002, "  \n", None), (2003, "Cut in the mid", "free"), (2004, "Half an entity &quo", "free"), (2005, "lost �", None), (2003, "Cut in the mid", "free")]
    want |= {2003, 2004, 2005}
    got = truncation.find_truncated(spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, source string, truncated boolean"))
    found = {r["doc_id"] for r in got.filter("truncated").collect()}
    assert len(found ^ want) <= 2 and {2003, 2004, 2005} <= found and got.filter("doc_id = 2003").count() == 4 or got.filter("doc_id = 2003").count() == 2
    rates = {r["source"]: r["share"] for r in truncation.truncation_rates(got).collect()}
    assert rates["field"] > 0.5 and rates["free"] < 0.05
    assert truncation.find_truncated(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def limited(rng):
    rows = []
    for i in range(600):
        body = " ".join(sentence(rng) for _ in range(rng.randint(3, 9)))
        rows.append((i, body[:200], "field") if i % 3 else (i, body[: rng.randint(30, 400)], "wire"))
    return rows


def test_length_histograms_decide_field_limits(spark, monkeypatch):
    df = spark.createDataFrame(limited(random.Random(9)), "doc_id long, text string, source string")
    cuts = lambda: {(r["source"], r["cut"]): r["count"] for r in truncation.find_truncated(df).filter("truncated").groupBy("source", "cut").count().collect()}
    with_spikes = cuts()
    assert with_spikes[("field", "limit")] > 250 and ("field", "transfer") not in with_spikes and with_spikes[("wire", "transfer")] > 100
    found = truncation.spikes
    monkeypatch.setattr(truncation, "spikes", lambda f: found(f).limit(0))
    without = cuts()
    assert ("field", "limit") not in without and ("field", "transfer") not in without and without[("wire", "transfer")] >= with_spikes[("wire", "transfer")]
