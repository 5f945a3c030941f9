import pytest

from folioframe.llm import names


@pytest.mark.parametrize("a,b,how", [
    ("Robert Hill", "ROBERT HILL", "same"), ("Robert Hill", "Bob Hill", "same"), ("Hill, Robert", "Robert Hill", "same"), ("Robert Hill", "Capt. Robert Hill", "same"), ("Zoë Drarow", "Zoe Drarow", "same"), ("Katharina Maresson", "Katharina Maréssön", "same"),
    ("Benedikt Eldket", "Bneedikt Eldket", "same"), ("Robert Hill", "R. Hill", "part"), ("Robert Hill", "Hill, R.", "part"), ("Robert Hill", "Mr Hill", "part"), ("Robert Hill", "Robert", "part"), ("Robert Hill", "Bob", "part"), ("Elisabeth Kesstad", "Elisabeth K.", "part"),
    ("Robert Hill", "Robert Mill", ""), ("Robert Hill", "Anna Hill", ""), ("Дмитрий Кестров", "Д. Кестров", "part"), ("Сергей Тамулин", "Sergey Tamulin", "same"), ("Юрий Тамулин", "Юра Тамулин", "same"),
    ("Orchard Wardens Company", "Company of Orchard Wardens", "same"), ("Orchard Wardens Company", "Orch. Wardens Co.", "same"), ("Orchard Wardens Company", "OWC", "part"), ("Orchard Wardens Company", "Orchard Wardens", "part"), ("Orchard Wardens Company", "Orchard Weavers Company", ""),
    ("钟远桥", "钟 远桥", "same"), ("钟远桥", "小桥", "part"), ("钟远桥", "Zhong Yuanqiao", "part"), ("钟远桥", "老钟", "part"), ("陈听雪", "罗听雪", ""), ("Narrator", "Narrator ", ""), ("the guard", "the guards", ""), ("", "?", ""),
])
def test_relate(a, b, how):
    assert names.relate(a, b) == how == names.relate(b, a)


def test_lcs_ratio():
    assert names.lcs_ratio("abc", "abc") == 1 and names.lcs_ratio("abcd", "acd") == 6 / 7 and names.lcs_ratio("ab", "cd") == 0


def test_link(spark):
    a = [("p", n) for n in ("Robert Hill", "Bob Hill", "R. Hill", "Anna Stone", "Rosa Stone", "Stone", "Ms. Lake", "Mr Lake", "羅雲舟", "罗云舟", "罗岚", "Crowd", None, " ", "Robert Hill")] + [("q", "Robert Hill"), (None, "Robert Hill"), ("r", "羅岚"), ("r", "罗岚")]
    df = spark.createDataFrame(a, "project_id string, name string")
    got = {(r["name_a"], r["name_b"]) for r in names.same_entity_pairs(names.link(names.distinct_names([(df, "name")]))).collect()}
    assert got == {("Bob Hill", "R. Hill"), ("Bob Hill", "Robert Hill"), ("R. Hill", "Robert Hill"), ("Mr Lake", "Ms. Lake"), ("罗云舟", "羅雲舟"), ("罗岚", "羅岚")}


def test_common_suffixes_are_refined_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON_SUFFIX", 5)
    df = spark.createDataFrame([("p", f"{f} Hollowford") for f in ("Anna", "ANNA", "Bela", "Conrad", "Dorothea", "Egbert", "Florian", "Gustav", "Hubert")], "project_id string, name string")
    assert names.same_entity_pairs(names.link(names.distinct_names([(df, "name")]))).count() == 1


@pytest.mark.parametrize("part", ["Mr. Selthorn", "Selthorn", "A. Selthorn", "Elthorn", "Xzelthorn", "Ezlthorn"])
def test_a_first_letter_error_is_met_in_common_blocks(spark, monkeypatch, part):
    others = [f"{f} {s}" for f, s in zip("Bela Conrad Dorothea Egbert Florian Gustav Hubert".split(), "Morthorn Dulthorn Karthorn Wynthorn Garthorn Lonthorn Perthorn".split(), strict=True)]
    df = spark.createDataFrame([("p", x) for x in (part, "Anna Zelthorn", *others)], "project_id string, name string")
    for common in (200, 2, 0):
        monkeypatch.setattr(names, "COMMON_SUFFIX", common)
        got = {(r["name_a"], r["name_b"]) for r in names.candidate_pairs(df).collect()}
        assert tuple(sorted((part, "Anna Zelthorn"))) in got


CROWD = (
    "Robert Hill; Bob Hill; R. Hill; Robert Hlil; Zobert Hill; Robert Bill; Mr. Hill; Hill, Robert; Anna Hill; Katharina Maresson; Catarina Maresson; Katharina Marreson; K. Maresson; Mahia Lind; Maria Lind; Maria; "
    "Orchard Wardens Company; Orch. Wardens Co.; OWC; Orchard Wardens; 钟远桥; 鍾遠橋; 鍾远桥; 老钟; Zhong Yuanqiao; Juri Tamulin; Юрий Тамулин; Karl Schwarzenberg; Karl Shwarzenburg; Bart Holowfrod; Bart Hollowford"
).split("; ")


def test_refined_and_shared_blocks_link_what_whole_blocks_link(spark, monkeypatch):
    df = spark.createDataFrame([("p", x) for x in CROWD], "project_id string, name string")
    links = lambda: {tuple(r) for r in names.same_entity_pairs(names.link(df)).collect()}
    want = links()
    monkeypatch.setattr(names, "COMMON_SUFFIX", 1)
    monkeypatch.setattr(names, "SHARE_ROWS", 2)
    monkeypatch.setattr(names, "LOCAL_EDGES", 3)
    assert links() == want and ("p", "鍾遠橋", "钟远桥") in want


@pytest.mark.parametrize("a,b", [("maresson", "marreson"), ("hollowford", "holowfrod"), ("aleksandrova", "alexandrova"), ("schwarzenberg", "shwarzenburg"), ("katharina", "catarina")])
def test_the_ratio_links_what_one_edit_would_not(a, b):
    assert names.near(a, b) and names.relate(f"Anna {a.title()}", f"Anna {b.title()}") == "same"


def test_without_the_ratio_typing_errors_are_lost(monkeypatch):
    monkeypatch.setattr(names, "lcs_ratio", lambda a, b: float(a == b))
    names.near.cache_clear()
    assert names.relate("Anna Maresson", "Anna Marreson") == "" and names.relate("Anna Maresson", "ANNA MARESSON") == "same"
    names.near.cache_clear()


def test_long_chains_are_one_component(spark, monkeypatch):
    monkeypatch.setattr(names, "LOCAL_EDGES", 7)
    n = 300
    nodes = spark.createDataFrame([("p", f"{i:04}") for i in range(n)] + [("q", "0001")], "project_id string, name string")
    edges = spark.createDataFrame([("p", f"{i:04}", f"{i + 1:04}") for i in range(n - 1) if i != 200], "project_id string, name_a string, name_b string")
    got = {(r["project_id"], r["name"]): r["entity"] for r in names.components(nodes, edges).collect()}
    assert {got[("p", f"{i:04}")] for i in range(201)} == {"0000"} and {got[("p", f"{i:04}")] for i in range(201, n)} == {"0201"} and got[("q", "0001")] == "0001" and len(got) == n + 1


def test_empty(spark):
    df = spark.createDataFrame([], "project_id string, name string")
    assert names.same_entity_pairs(names.link(names.distinct_names([(df, "name")]))).count() == 0
