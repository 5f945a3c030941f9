import pytest

from folioframe.llm import sentences as S
from folioframe.llm.sentences import sentences, split_sentences


@pytest.mark.parametrize("want", [
    ["Dr. Smith paid $3.50 for No. 7.", "He left."], ["They left at 6 a.m.", "Nobody saw it."], ["“Wait!", "Who’s there?” called Tom."], ["“Where is it?” Ann asked.", "No one knew."],
    ["“Go,” said Ann, “before the bell...”", "They ran."], ["Rope, oil, etc.", "Nothing else."], ["J. R. Hill of St. Mary wrote to Mr. and Mrs. Lee."], ["Das Schiff fuhr z. B. im 2. Winter nicht aus.", "Die Tür war zu."],
    ["„Komm herein!“, rief die Müllerin.", "Er kam."], ["« Attendez !", "La porte est fermée. »", "Il partit."], ["—¿Vienes? —preguntó el capitán.", "Nadie respondió."], ["Esperó… y no dijo nada."],
    ["Тебя не было!", "— Кто там? — спросил он."], ["He did what?!", "‘Run!’ she hissed, and they ran."], ["(The lamp was out.)", "She came back."], ["He hesitated…", "Then the door opened."],
])
def test_spaced(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


@pytest.mark.parametrize("want", [["“你是谁？”老人问道。", "“快跟上。”他说。"], ["“别动！", "外面有人。”", "他走了。"], ["温度升到了3.5度，他却没有停下。", "他犹豫了……最后还是开了门。"], ["「待て！", "まだ早い。」", "「行こう。」と彼は言った。"]])
def test_unspaced(want):
    text = "".join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


def test_other_scripts():
    assert len(sentences("عاد الصياد. هل رأيت المفتاح؟")) == 2 and len(sentences("वह आया। वह गया॥")) == 2 and len(sentences("เขาเดินกลับบ้าน เธออ่านจดหมาย")) == 2


@pytest.mark.parametrize("text", [None, "", "   \n\t "])
def test_nothing(text):
    assert sentences(text) == []


def test_lines_always_end_and_everything_is_covered():
    text = "No end here\nSecond.  Third\r\n\r\n... !"
    got = sentences(text)
    assert "".join(text[a:b] for a, b in got).replace(" ", "") == "".join(text.split()) and got[0] == (0, 11)


def test_long_text():
    text = "Mr. Hill came at 5 p.m. sharp. " * 5000
    assert len(sentences(text)) == 5000


def test_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (1, "A b. C d.", "x"), (2, None, "x"), (3, "", "x")], "id long, text string, sentence string")
    assert split_sentences(df, "id", "text").count() == 2 and split_sentences(df.limit(0), "id", "text").count() == 0


TWELVE = {
    "en": ["Mrs. Lee met Mr. Hill at No. 7.", "He left."], "de": ["Hr. Lang kam am 3. Mai.", "Er ging."], "fr": ["M. Hugo arrive vers midi, cf. page 3.", "Il part."], "es": ["El Sr. Gil llegó a la pág. 4.", "Se fue."],
    "pt": ["O Sr. Gil leu a pág. 4 hoje.", "Foi embora."], "it": ["Il Sig. Neri lesse pag. 4 oggi.", "Partì."], "nl": ["Dhr. Bos las blz. 4 van het boek.", "Hij ging."], "ru": ["На стр. 4 и рис. 5 ничего нет.", "Он ушёл."],
}


@pytest.mark.parametrize("lang", sorted(TWELVE))
def test_each_language_has_a_table_that_decides(lang, monkeypatch):
    text = " ".join(TWELVE[lang])
    cut = lambda: [text[a:b] for a, b in sentences(text, lang)]
    assert cut() == TWELVE[lang] and S.LANGUAGE_RULES[lang] != S.LANGUAGE_RULES[""]
    monkeypatch.setitem(S.LANGUAGE_RULES, lang, [])
    S.cascade.cache_clear()
    assert cut() != TWELVE[lang]
    S.cascade.cache_clear()


def test_scripts_have_tables_that_decide(monkeypatch):
    for lang, text, n in (("zh", "他说“走吧……快”。好。", 2), ("ja", "待て……と言った。行く。", 2), ("th", "เขาไป เธออ่าน", 2), ("hi", "वह आया। वह गया॥", 2), ("ar", "عاد الصياد؟ نعم", 2)):
        assert len(sentences(text, lang)) == n and lang in S.LANGUAGE_RULES and S.SCRIPT_RULES[S.SCRIPT_OF[lang]]
    monkeypatch.setattr(S, "DEFAULT_RULES", [])
    monkeypatch.setattr(S, "SCRIPT_RULES", {})
    S.cascade.cache_clear()
    assert sentences("He came. She left. 他走了。好。") == [(0, 25)]  # without rules there is no break
    S.cascade.cache_clear()


def test_time_grows_with_the_text_only():
    import time

    def took(text):
        t = time.perf_counter()
        sentences(text)
        return time.perf_counter() - t

    part = "The captain said nothing. Dr. Hill left at 5 p.m. sharp."
    took(part)
    for sep in ("\n", " "):
        small, large = took(sep.join([part] * 400)), took(sep.join([part] * 6400))
        assert large < 64 * small + 0.2
