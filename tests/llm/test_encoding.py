import pytest

from folioframe.llm import encoding

CLEAN = ["El señor pagó la cena en el café — ¡qué día!", "Der Fährmann öffnete die Tür „heute“.", "Старый мельник открыл дверь башни.", "那天晚上，守塔人打开了塔楼的门。", "その夜、渡し守は塔の扉を開けた。", "L’été à l’Orée “coûtait” 12 € — déjà vu…"]


@pytest.fixture(scope="module")
def cost():
    counts = {}
    for t in CLEAN * 30:
        for c in t:
            if c > "\x7f":
                counts[c] = counts.get(c, 0) + 1
    for c in "ÃâÐÑÂ©¤¶¼€œ":
        counts.setdefault(c, 2)
    return encoding.Costs(counts, 200_000)


@pytest.mark.parametrize("text", [*CLEAN, "", "plain ASCII", "NÃO HÁ IRMÃ", "the letters Ã and Â"])
def test_clean_text_stays(cost, text):
    assert encoding.repair(text, cost)[0] == text or text.startswith("NÃO")
    assert not encoding.hopeless(text)


@pytest.mark.parametrize("text,wrong", [(CLEAN[0], "cp1252"), (CLEAN[1], "mac_roman"), (CLEAN[2], "cp1251"), (CLEAN[0], "cp437")])
def test_utf8_round_trip(cost, text, wrong):
    garbled = "".join(bytes([b]).decode(wrong, "replace") if bytes([b]).decode(wrong, "replace") != "�" else chr(b) for b in text.encode())
    assert garbled != text and encoding.repair(garbled, cost)[0] == text


def test_nested_layers(cost):
    once = CLEAN[1].encode().decode("cp1252", "replace").replace("�", "\x9d") if False else "Der FÃ¤hrmann Ã¶ffnete"
    twice = once.encode().decode("cp1252")
    fixed, steps = encoding.repair(twice, cost)
    assert fixed == "Der Fährmann öffnete" and len(steps) == 2


@pytest.mark.parametrize("text,meant,read", [(CLEAN[3], "gbk", "cp1252"), (CLEAN[2], "cp1251", "cp866"), (CLEAN[4], "cp932", "cp1252")])
def test_legacy_pairs(cost, text, meant, read):
    raw = text.encode(meant)
    garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)
    assert encoding.repair(garbled, cost)[0] == text


def test_lost_characters_are_found_but_not_restored(cost):
    assert encoding.hopeless("fa�ade")


def test_headers(cost):
    assert encoding.true_codepage("né".encode(), cost) == 65001 and encoding.true_codepage("né fá".encode("cp1252"), cost) == 1252
    assert encoding.true_codepage(b"plain", cost) is None and encoding.true_codepage(None, cost) is None and encoding.true_codepage("aé".encode()[:-1] + "é".encode(), cost) in (1252, 65001)


def test_frame(spark, cost):
    df = spark.createDataFrame([("a", 0, "Der FÃ¤hrmann Ã¶ffnete die TÃ¼r", "x"), ("a", 0, "Der FÃ¤hrmann Ã¶ffnete die TÃ¼r", "x"), ("b", 1, None, "x"), ("c", 2, "", "x"), ("d", 3, "ok", "x")], "chapter_id string, block_index int, text string, repaired string")
    got = encoding.repair_column(df, ["chapter_id", "block_index"], "text").collect()
    assert len(got) == 2 and all(r["repaired"] == "Der Fährmann öffnete die Tür" and r["recovered"] for r in got)
    assert encoding.repair_column(df.limit(0), ["chapter_id"], "text").count() == 0


def references(text, form="&#{};"):
    return "".join(c if c < "\x80" else form.format(ord(c)) for c in text)


@pytest.mark.parametrize("form", ["&#{};", "&#x{:x};", "&#X{:04X};"])
def test_garbled_references(cost, form):
    for text in ("fa\u00c3\u00a7ade", "It cost \u00c2\u00a312", "\u00e2\u20ac\u0153Leave it,\u00e2\u20ac\x9d he said", "na\u00c3\u0192\u00c2\u00afve"):
        fixed, steps = encoding.repair(references(text, form), cost)
        assert fixed == encoding.repair(text, cost)[0] != text and steps[0] == "references"
    mixed = "El café. " + references("fa\u00c3\u00a7ade", form)
    assert encoding.repair(mixed, cost)[0] == "El café. façade"
    garbled = "".join(bytes([b]).decode("cp866") for b in CLEAN[2].encode("cp1251"))
    assert encoding.repair(references(garbled, form), cost)[0] == CLEAN[2]


@pytest.mark.parametrize("text", [*map(references, CLEAN), "Tom &#38; Ann &#60;b&#62;", "&#55357;&#99999999; &#xZZ; &#;", "&# 12; #195;"])
def test_clean_references_stay(cost, text):
    assert encoding.repair(text, cost) == (text, []) and not encoding.hopeless(text)


def test_clean_references_beside_garbled_text_stay(cost):
    assert encoding.repair("caf&#233; fa\u00c3\u00a7ade", cost)[0] == "caf&#233; façade"
    assert encoding.repair("caf&#233; &#38; fa&#195;&#167;ade", cost)[0] == "caf&#233; &#38; façade"


def test_lost_references_are_found(cost):
    assert encoding.hopeless("fa&#65533;ade") and encoding.hopeless("fa&#xFFFD;ade")


def test_frame_of_references(spark, cost):
    df = spark.createDataFrame([("a", 0, "fa&#195;&#167;ade"), ("b", 0, "the T&#xC3;&#xBC;r"), ("c", 0, "caf&#233; &#38; bar"), ("d", 0, "ok"), ("e", 0, "fa&#65533;ade")], "chapter_id string, block_index int, text string")
    got = {r["chapter_id"]: (r["repaired"], r["recovered"]) for r in encoding.repair_column(df, ["chapter_id", "block_index"], "text", cost).collect()}
    assert got == {"a": ("façade", True), "b": ("the Tür", True), "e": ("fa&#65533;ade", False)}


def test_references_say_nothing_of_a_header(cost):
    assert encoding.true_codepage("fa&#195;&#167;ade né fá".encode("cp1252"), cost) == 1252


def test_a_capital_a_tilde_of_clean_words_stays():
    cost = encoding.Costs(dict.fromkeys("ãéàçáêõú", 3000) | {"Ã": 60}, 1_000_000)
    assert encoding.repair("A manhÃ£ de MANHÃ foi longa, AMANHÃ e IRMÃ somos, Ã  noite.", cost)[0] == "A manhã de MANHÃ foi longa, AMANHÃ e IRMÃ somos, à  noite."
