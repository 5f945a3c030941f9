import pytest

from folioframe.llm import langid

TEXTS = {
    "en": ["The old captain opened the door of the tower.", "Nobody has seen the second key, said the guard.", "She was looking at the sea without a word.", "He had hidden the letter behind the church.", "They burned the maps of the kingdom at dawn.", "The tailor lost the key to the attic."],
    "de": ["Der alte Hauptmann öffnete die Tür des Turmes.", "Niemand hat den zweiten Schlüssel gesehen, sagte der Wächter.", "Sie blickte schweigend auf das Meer.", "Er hatte den Brief hinter der Kirche versteckt.", "Sie verbrannten die Karten des Königreichs.", "Die Näherin verlor den Schlüssel zum Dachboden."],
    "ru": ["Старый капитан открыл дверь башни.", "Никто не видел второго ключа, сказал сторож.", "Она молча смотрела на море.", "Он спрятал письмо за церковью.", "Они сожгли карты королевства.", "Портной потерял ключ от чердака."],
    "zh": ["那位船长打开了塔楼的门。", "没有人见过第二把钥匙，守塔人说。", "她默默地望着大海。", "他把信藏在寺庙后面。", "他们烧掉了王国的地图。", "他默默地打开了寺庙的门。"],
}


@pytest.fixture(scope="module")
def model():
    return langid.fit({k: v[:5] * 3 for k, v in TEXTS.items()}, 2)


def test_held_out(model):
    got = model.classify([v[5] for v in TEXTS.values()])
    assert [g[0] for g in got] == list(TEXTS) and all(g[1] > 0 for g in got)


def test_rejects(model):
    assert [g[0] for g in model.classify(["", "1234 5678", "ᚠᚢᚦᚨᚱᚲ"])] == ["und"] * 3


def test_stretches(model):
    text = f"{TEXTS['en'][0]} {TEXTS['de'][1]} {TEXTS['en'][2]}"
    got = langid.stretches([text, "", TEXTS["ru"][0] + " «Halberg» " + TEXTS["ru"][1]], model)
    assert [x[2] for x in got[0]] == ["en", "de", "en"] and got[0][0][0] == 0 and got[0][-1][1] == len(text) and got[1] == [] and [x[2] for x in got[2]] == ["ru"]


@pytest.mark.parametrize("label,code", [("en", "en"), ("EN_au", "en"), ("zh-Hans", "zh"), ("ger", "de"), (" Dutch ", "nl"), ("Dutch (Flemish)", "nl"), ("und", None), ("xx", None), ("", None), (None, None), ("n/a", None)])
def test_labels(spark, label, code):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(label,)], "l string").select(langid.normal_label(F.col("l")).alias("c")).first()["c"] == code


def test_found(spark, model):
    blocks = [("b1", "c1", 0, TEXTS["de"][0]), ("b1", "c1", 1, TEXTS["de"][1]), ("b1", "c1", 1, TEXTS["de"][1]), ("b2", "c2", 0, TEXTS["en"][0] + " " + TEXTS["ru"][0]), ("b2", "c2", 1, TEXTS["en"][1]), ("b3", "c3", 0, None), ("b3", "c3", 1, "")]
    books = spark.createDataFrame([("b1", "en"), ("b1", "en"), ("b2", "eng"), ("b3", "fr"), ("b4", None)], "book_id string, lang_label string")
    got = langid.found(books, spark.createDataFrame(blocks, "book_id string, chapter_id string, block_index int, text string"), model)
    assert sorted(tuple(r) for r in got.collect()) == [("block", "c2", 0), ("book", "b1", -1), ("book", "b4", -1)]


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, TEXTS["en"][i % 6] * 2, "English") for i in range(200)] + [(999, TEXTS["de"][0] * 2, "de"), (1000, "x" * 50, "??"), (1001, None, "en")], "doc_id long, text string, lang string")
    got = langid.training_sample(df, "text", "lang", "doc_id", 20)
    assert set(got) == {"en"} and len(got["en"]) <= 20 * langid.UNITS and langid.training_sample(df.limit(0), "text", "lang", "doc_id") == {}
