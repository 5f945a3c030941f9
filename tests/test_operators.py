import hashlib
import io
import struct
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioframe.operators import context, dag, diff, document, evaluate, extract, integrity, memory, proofread
from folioframe.plans import story
from folioframe.sources import epub, html, mobi, pdf_words, plain, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def source(spark, *texts):
    return spark.createDataFrame([(f"c{i}", f"s{i}", "h", 0, t) for i, t in enumerate(texts)], "chapter_id string, source_id string, source_hash string, start_byte long, text string")


def test_plain_import(spark):
    raw = [("a.txt", b"\xef\xbb\xbfLead in\r\nstill\r\n\r\nChapter One\r\n***\nlast \xc3\xa9"), ("bad", b"\xff\xfe"), ("empty", b" \n"), ("cut", b"a\xc3")]
    texts, errors = plain.decode(spark.createDataFrame(raw, "source_id string, content binary"))
    assert rows(errors) == [("bad", "InvalidUtf8"), ("cut", "InvalidUtf8"), ("empty", "EmptyInput")]
    lined = plain.lines(texts, base=F.col("base"))
    got = rows(plain.blocks(lined).select("chapter_index", "block_index", "block_type", "text", "start_byte", "end_byte"))
    assert got == [(0, 0, "paragraph", "Lead in still", 3, 17), (1, 0, "heading", "Chapter One", 21, 32), (1, 1, "scene_break", "***", 34, 37), (1, 2, "paragraph", "last é", 38, 45)]


def test_lines_have_no_trailing_empty_one(spark):
    df = spark.createDataFrame([("a", "x\ny\n"), ("b", ""), ("c", "\n\n"), ("d", None)], "source_id string, text string")
    assert rows(plain.lines(df).select("source_id", "line", "start_byte")) == [("a", "x", 0), ("a", "y", 2), ("c", "", 0), ("c", "", 1)]


def test_detectors(spark):
    s = source(spark, "the  the cat , ran,,off..now (x\nrow\n row \n", "a,b")
    got = {(r["detector"], r["start_byte"], r["original"], r["suggestion"]) for r in proofread.analyze(s).collect()}
    assert ("multiple_blanks", 3, "  ", " ") in got and ("duplicate_tokens", 3, "  the", "") in got and ("blank_before_punctuation", 12, " ", "") in got
    assert ("repeated_punctuation", 18, ",,", ",") in got and ("two_dot_ellipsis", 23, "..", "...") in got and ("unmatched_brackets", 29, "(", "") in got
    assert ("repeated_lines", 36, " row ", "") in got and ("missing_blank", 2, "", " ") in got


def test_protection_and_names(spark):
    s = source(spark, "Halberg Halberg met Holberg near the  gate", "the  gate")
    found = proofread.pattern_detector(s, "multiple_blanks")
    assert found.count() == 2 and proofread.without_protected(found, proofread.protected_spans(s, ["the  gate"])).count() == 0
    assert rows(proofread.name_variants(s, ["Halberg", "Two Words"]).select("original", "suggestion", "start_byte")) == [("Holberg", "Halberg", 20)]
    assert rows(proofread.name_frequency(s, ["Halberg", "Nobody"])) == [("Halberg", 2), ("Nobody", 0)]


def test_bracket_stack():
    assert proofread.unmatched("(a] b)") == [(2, "]")] and proofread.unmatched("([)") == [(0, "("), (1, "["), (2, ")")] and proofread.unmatched("") == []


def test_document_rules(spark):
    books = spark.createDataFrame([("b1", "p", " ", "txt", "l", "zz")], "book_id string, project_id string, title string, source_format string, source_locator string, source_hash string")
    chapters = spark.createDataFrame([("c1", "b1", 1, "t")], "chapter_id string, book_id string, chapter_index int, title string")
    blocks = spark.createDataFrame([("c1", 0, "paragraph", "", "s", 0, 5, 2.0), ("c1", 1, "paragraph", "x", "s", 4, 8, None), ("c1", 2, "heading", "x", "s", 9, 8, None)], "chapter_id string, block_index int, block_type string, text string, source_id string, start_byte long, end_byte long, extraction_confidence double")
    codes = {r["code"] for r in document.validate(books, chapters, blocks).collect()}
    assert codes == {"InvalidBookId", "MissingMetadata", "InvalidSourceHash", "InvalidChapterId", "InvalidChapterOrder", "EmptyBlockText", "InvalidExtractionConfidence", "OverlappingSourceSpan", "InvalidSourceSpan"}


def test_extraction_scores(spark):
    seg = "case_id string, segment_index int, segment_type string, speaker string, start_byte long, end_byte long"
    g = spark.createDataFrame([("a", 0, "dialogue", "X", 0, 10), ("a", 1, "narration", None, 10, 20)], seg)
    whole = spark.createDataFrame([("a", 0, 20)], "case_id string, e_start long, e_end long")
    half = spark.createDataFrame([("a", 0, "dialogue", "X", 0, 10)], seg)
    assert evaluate.coverage(whole, half).first()["coverage"] == 0.5 and evaluate.boundary_f1(whole, g, g).first()["boundary_f1"] == 1.0
    assert evaluate.speaker_scores(g, half).first()["speaker_accuracy"] == 1.0
    w = evaluate.weighted_accuracy(g, half.unionByName(half.withColumn("start_byte", F.lit(10)).withColumn("end_byte", F.lit(20)))).first()
    assert w["dialogue_accuracy"] == 0.5
    a = lambda *x: F.array(*(F.lit(i) for i in x)).cast("array<string>")
    v = spark.range(1).select(evaluate.label_f1(a("x"), a("x", "y"), a("y")).alias("f"), evaluate.label_f1(a(), a(), a()).alias("n"), evaluate.hallucination_rate([(a(), a())]).alias("h"), evaluate.hallucination_rate([(a("x", "y"), a("x"))]).alias("q")).first()
    assert v["f"] == 0.0 and v["n"] is None and v["h"] == 0.0 and v["q"] == 0.5


def test_cost_metrics_need_every_case(spark):
    m = spark.createDataFrame([("a", "latency_ms", 1.0), ("b", "latency_ms", None), ("a", "f1", 1.0), ("b", "f1", None)], "case_id string, metric string, value double")
    assert rows(evaluate.aggregate_run(m)) == [("f1", 1.0), ("latency_ms", None)]


def test_story_memory_ignores_row_order(spark):
    rec = [("p", "c0", 0, 1, "Ada", ["the clerk"]), ("p", "c0", 0, 2, "Bo", []), ("p", "c1", 1, 3, " ada ", ["The Clerk", "A."])]
    schema = "project_id string, chapter_id string, sequence int, position int, name string, aliases array<string>"
    a, b = (rows(memory.characters(spark.createDataFrame(x, schema)).select("name", F.array_join("aliases", "|"), "n_chapters", "last_sequence")) for x in (rec, rec[::-1]))
    assert a == b == [("Ada", "A.|the clerk", 2, 1), ("Bo", "", 1, 0)]
    names = memory.local_names(spark.createDataFrame(rec, schema))
    ev = spark.createDataFrame([("p", "c0", 0, "e", "ADA"), ("p", "c0", 0, "e", "Bo"), ("p", "c0", 0, "e", "Cy")], "project_id string, chapter_id string, sequence int, event_id string, participant string")
    done = memory.resolve_participants(ev, names)
    assert done.filter("character_id IS NULL").count() == 1 and memory.relationships(done).first()["n_events"] == 1


def test_integrity_death_and_travel(spark):
    ev = spark.createDataFrame([(1, 1, "death", 1, 0, None, None, None, True, 0.9), (2, 1, "revival", 2, 0, None, None, None, False, 1.0), (3, 1, "speech", 3, 0, None, None, None, True, 0.5), (4, 1, "revival", 4, 0, None, None, None, True, 1.0), (5, 1, "speech", 5, 0, None, None, None, True, 1.0),
        (6, 1, "location", 6, 0, None, None, 1, True, 1.0), (7, 1, "location", 7, 0, None, None, 9, True, 1.0), (8, 1, "location", 8, 0, None, None, 2, True, 1.0), (9, 1, "location", 9, 0, None, None, 1, True, 1.0), (10, 7, "speech", 1, 0, None, None, None, True, 1.0)],
        "event_id long, character_id long, kind string, tick long, ord long, used_name string, information_id long, location_id long, grounded boolean, confidence double")
    chars = spark.createDataFrame([(1, "A", 0, 0)], "character_id long, name string, from_tick long, from_ord long")
    none = spark.createDataFrame([], "character_id long, name string, from_tick long, from_ord long, until_tick long, until_ord long")
    places = spark.createDataFrame([(1,), (2,)], "location_id long")
    travel = spark.createDataFrame([(2, 1, 5)], "from_id long, to_id long, minimum_ticks long")
    info = spark.createDataFrame([], "information_id long")
    rev = spark.createDataFrame([], "information_id long, character_id long, from_tick long, from_ord long")
    got = rows(integrity.check(ev, chars, none, places, travel, info, rev).select("event_id", "rule", "confidence"))
    assert got == [(3, "SPEECH_AFTER_DEATH", 0.5), (7, "UNRESOLVED_LOCATION", 1.0), (9, "IMPOSSIBLE_LOCATION_TRANSITION", 1.0), (10, "UNRESOLVED_CHARACTER", 1.0)]


def test_context_skips_what_does_not_fit(spark):
    ctx = spark.createDataFrame([("x", "r", None, [], None, "c", "t", 100, 0), ("y", "r" * 900, None, [], None, "c", "t", 20, 10)], "context_id string, system_rules string, background string, terminology array<string>, recent_summary string, current_chapter string, task string, maximum_tokens int, reserved_completion_tokens int")
    base = {"system_rules": "r", "background": None, "terminology": [], "recent_summary": None, "current_chapter": "c", "task": "t"}
    room = 100 - context.estimate(context.render(base, {k: [] for k in context.KINDS}))
    assert room > 8
    ranked = spark.createDataFrame([("x", 1, "character", "w " * 200), ("x", 2, "character", "ab"), ("x", 3, "thread", "cd")], "context_id string, place int, kind string, text string")
    got = {r["context_id"]: r for r in context.build(ctx, ranked).collect()}
    assert got["x"]["n_characters"] == 1 and got["x"]["n_threads"] == 1 and got["x"]["omitted_characters"] == 1 and "- ab" in got["x"]["prompt"]
    assert got["x"]["estimated_tokens"] == context.estimate(got["x"]["prompt"]) <= 100 and got["y"]["error"]


def lcs_reference(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_hunks_rebuild_and_are_minimal():
    import random

    random.seed(1)
    for _ in range(200):
        a = [random.choice("abé一") * random.randint(0, 2) + "\n" for _ in range(random.randint(0, 9))]
        b = [random.choice([x, "z\n"]) for x in a] + random.choice([[], ["end"]])
        old, new = "".join(a).encode(), "".join(b).encode()
        found, capped = diff.hunks(old, new)
        out, at = b"", 0
        for s, e, t, u in found:
            out += old[at:s] + new[t:u]
            at = e
        assert out + old[at:] == new and not capped
    big = b"".join(b"%d\n" % i for i in range(1100))
    assert diff.hunks(big, big[::-1])[1] and diff.hunks(big, big) == ([], False)


def test_diff_frames(spark):
    edits = spark.createDataFrame([("s", 2, 4, 5), ("s", 10, 10, 3)], "source_id string, old_start long, old_end long, new_len long")
    points = spark.createDataFrame([("s", p) for p in (0, 2, 3, 4, 10, 11)], "source_id string, point long")
    assert rows(diff.mapped_offsets(points, edits)) == [("s", 0, 0), ("s", 2, 2), ("s", 3, None), ("s", 4, 7), ("s", 10, 16), ("s", 11, 17)]
    assert [r["delta"] for r in diff.running_delta(edits).orderBy("old_start").collect()] == [0, 3]
    one = spark.createDataFrame([("TextOnly",), ("Unknown",), ("TypoOnly",)], "i string")
    assert one.agg(diff.strongest(F.col("i")).alias("x")).first()["x"] == "Unknown"
    assert bytes(spark.range(1).select(diff.splice(F.lit("aéb"), F.lit(1), F.lit(3), F.lit("xy")).alias("x")).first()["x"]) == b"axyb"


def test_graph(spark):
    arts = spark.createDataFrame([("a", "source", ""), ("b", "analysis", ""), ("c", "story", ""), ("d", "story", "")], "artifact_id string, kind string, input_hash string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c")], "artifact_id string, dependency_id string")
    order, rest = dag.levels(arts, edges)
    assert rows(order) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)] and rest.count() == 0
    loop = edges.union(spark.createDataFrame([("b", "d")], edges.schema))
    assert rows(dag.levels(arts, loop)[1]) == [("b",), ("c",), ("d",)]
    roots = spark.createDataFrame([("a",)], "artifact_id string")
    dirty = dag.dirty_closure(roots, arts, edges)
    assert rows(dirty) == [("b",), ("c",), ("d",)]
    assert rows(dag.rebuild_plan(spark.createDataFrame([("c",)], "artifact_id string"), dirty, arts, edges)) == [("b", 1), ("c", 2)]
    assert dag.topological_order(["b", "a", "c"], [("c", "b")]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        dag.topological_order(["a", "b"], [("a", "b"), ("b", "a")])
    t = spark.createDataFrame([("a", 1, "f")], "artifact_id string, serial int, fingerprint string")
    r = spark.createDataFrame([("a", 1, "f", "x"), ("a", 0, "f", "y"), ("z", 1, "f", "z")], "artifact_id string, serial int, fingerprint string, out string")
    assert rows(dag.accept_results(r, t).select("out")) == [("x",)]

    def fail(_):
        raise RuntimeError

    assert dag.rebuild(["a", "b"], lambda x: x + "!") == ({"a": "a!", "b": "b!"}, None) and dag.rebuild(["a"], fail) == ({}, "a")


def test_json_schema(spark):
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": ["integer", "null"]}, "l": {"type": "array", "items": {"type": "string"}}}}
    df = spark.createDataFrame([('{"k": 1.0}',), ('{"l": [1]}',), ('{"k": true, "z": 0}',), ("x",), (None,)], "j string")
    assert [len(r["problems"]) for r in extract.validate_json(df, "j", schema).collect()] == [0, 2, 2, 1, 1]
    with pytest.raises(ValueError):
        extract.validate_json(df, "j", {"oneOf": []})


def test_claims(spark):
    out = '{"characters":[{"name":"Ada","aliases":[],"inferred":false,"confidence":1.0,"evidence":[{"source_start":10,"source_end":13}]}],"events":[],"locations":[],"open_threads":[{"text":"Who?","inferred":true,"confidence":0.5,"evidence":[]}]}'
    claims = extract.analysis_claims(spark.createDataFrame([("c", out)], "chapter_id string, output string"))
    assert claims.count() == 2 and extract.grounded(claims).count() == 2
    src = spark.createDataFrame([("c", "s", 10, "Ada ran")], "chapter_id string, source_id string, start_byte long, text string")
    assert {r["evidence_text"] for r in extract.evidence_texts(claims, src).collect()} == {"Ada", None}
    found = spark.createDataFrame([("c", 10, 13, "Adam", "TYPO", "TEXT_ONLY", 1.0), ("c", 10, 13, "Ada", "TYPO", "TEXT_ONLY", 1.0), ("c", 0, 3, "x", "TYPO", "TEXT_ONLY", 1.0)], "chapter_id string, source_start long, source_end long, suggestion string, category string, impact string, confidence double")
    good, bad = extract.semantic_candidates(found, src)
    assert rows(good.select("original", "suggestion")) == [("Ada", "Adam")] and rows(bad.select("code")) == [("InvalidSpan",), ("NoChange",)]


def test_html():
    blocks, anchors = html.scan("<!DOCTYPE html><head><title>t</title></head><h1 id='a'>A &amp; B</h1><p>x<br/>y é<script>no</script></p><hr><li>open")
    assert [(k, t) for k, t, *_ in blocks] == [("heading", "A & B"), ("paragraph", "x y é"), ("scene_break", ""), ("paragraph", "open")] and anchors[0][0] == "a"
    assert html.decode_entities("&#65;&#xD800;&#x110000;&bogus;&nbsp;") == "A&#xD800;&#x110000;&bogus; " or html.decode_entities("&#65;") == "A"
    assert html.fragment_text("a<br>b <img alt='c'/> <i>d</i>") == "a b c d"
    assert html.xhtml_problem(b"<!DOCTYPE x><a/>") == "DocumentType" and html.xhtml_problem(b"<a>") == "NotWellFormed" and html.xhtml_problem(b"<a>\xff</a>") == "InvalidUtf8" and html.xhtml_problem(b"<a/>") is None


def make_epub(**change):
    files = {
        "mimetype": "application/epub+zip", "META-INF/container.xml": "<container><rootfiles><rootfile full-path='E/p.opf'/></rootfiles></container>",
        "E/p.opf": "<package><metadata><title>T</title><creator>A</creator><language>en</language></metadata><manifest><item id='n' href='nav.xhtml' properties='nav'/><item id='a' href='a.xhtml'/></manifest><spine><itemref idref='a'/></spine></package>",
        "E/nav.xhtml": "<html><nav type='toc'><a href='a.xhtml'>One</a><a href='a.xhtml#two'>Two</a></nav></html>", "E/a.xhtml": "<html><body><p>first</p><h2 id='two'>Two</h2><p>second</p></body></html>",
    } | change
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_epub(spark):
    df = spark.createDataFrame([("x/a.epub", make_epub()), ("bad", b"no"), ("dtd", make_epub(**{"E/a.xhtml": "<!DOCTYPE html><html/>"}))], "source_id string, content binary")
    got = epub.blocks(df)
    assert rows(got.filter("error IS NULL").select("chapter_title", "block_index", "text")) == [("One", 0, "first"), ("Two", 0, "Two"), ("Two", 1, "second")]
    assert rows(got.filter("error IS NOT NULL").select("source_id", "error")) == [("bad", "NotAnArchive"), ("dtd", "DocumentType")]
    with pytest.raises(epub.BadBook):
        epub.resolved("E/p.opf", "../../x")


def make_mobi(text, codepage=1252, compression=1):
    exth = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in ((100, b"Au"), (524, b"de"), (503, b"Ti")))
    exth = b"EXTH" + struct.pack(">II", 12 + len(exth), 3) + exth
    head = bytearray(struct.pack(">HHIHHHH", compression, 0, len(text), 1, 4096, 0, 0) + b"MOBI" + struct.pack(">III", 232, 2, codepage) + b"\0" * 216)
    struct.pack_into(">I", head, 0x80, 0x40)
    recs = [bytes(head[:248]) + exth, text]
    at, table = 78 + 16, b""
    for r in recs:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return b"n" * 32 + b"\0" * 28 + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", 2) + table + b"".join(recs)


def test_mobi(spark):
    body = "<html><body><h1>Eins</h1><p>F\xe4hrmann</p></body></html>".encode("cp1252")
    got = mobi.blocks(spark.createDataFrame([("a.mobi", make_mobi(body)), ("b", b"x" * 100)], "source_id string, content binary"))
    assert rows(got.filter("error IS NULL").select("title", "language", "block_type", "text")) == [("Ti", "de", "heading", "Eins"), ("Ti", "de", "paragraph", "Fährmann")] and got.filter("error = 'NotABook'").count() == 1
    assert mobi.palmdoc(b"\x02ab\xc1\x80\x10") .startswith(b"ab A") and mobi.strip_trailers(b"abc\x01\x82", 2) == b"abc"
    with pytest.raises(epub.BadBook):
        mobi.palmdoc(b"\x80\x08")


def test_pdf_words(spark):
    w = [("p", "Left", 10.0, 10.0, 50.0, 20.0), ("p", "col", 55.0, 10.0, 80.0, 20.0), ("p", "more", 10.0, 30.0, 60.0, 40.0), ("p", "Right", 310.0, 10.0, 360.0, 20.0), ("p", "end", 310.0, 30.0, 350.0, 40.0), ("p", "12", 200.0, 790.0, 210.0, 799.0)]
    df = spark.createDataFrame([(*x, 600.0, 800.0) for x in w], "page_id string, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert [r["text"] for r in pdf_words.lines(df).orderBy("line_no").collect()] == ["Left col", "more", "Right", "end"]


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, t int")
    b = spark.createDataFrame([(2, "n", 2), (2, "z", 3), (3, "w", 1)], "id int, v string, t int")
    assert rows(store.upsert(a, b, ["id"], "t")) == [(1, "x", 1), (2, "z", 3), (3, "w", 1)] and store.insert_new(a, b, ["id"]).count() == 3
    c = spark.createDataFrame([(1, "x", "q"), (2, "no", "q")], "id int, expected string, value string")
    assert rows(store.update_where(a, c, ["id"], "v", "v").select("id", "v")) == [(1, "q"), (2, "y")]
    p, ch = store.delete_cascade(a, spark.createDataFrame([(10, 1), (11, 2)], "cid int, pid int"), a.filter("id = 1"), "id", "pid")
    assert p.count() == 1 and ch.count() == 1
    for v in ("v1", "v2"):
        store.write_all(spark, {"a": a if v == "v1" else b}, str(tmp_path), v)
    assert store.read_all(spark, str(tmp_path), ["a"])["a"].count() == 3
    good, bad = store.from_json_rows(store.to_json_rows(a, "id").withColumn("hash", F.when(F.col("id") == 1, "0").otherwise(F.col("hash"))), "id int, t int, v string")
    assert good.count() == 1 and bad.count() == 1 and store.schema_problems(a, "id int,z int") == ["missing z"]


def test_stream(spark, tmp_path):
    from folioframe.streaming import streams

    rows_ = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows_.write.parquet(str(tmp_path / "in"))
    out = streams.windowed_counts(streams.read_events(spark, str(tmp_path / "in")), "ts", ["k"])
    q = out.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("win").collect()) == [1, 2]


def test_latest_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "id int, v string, ingested_at int")
    assert rows(document.latest(df, ["id"])) == [(1, "b", 1)] and document.latest(df.limit(0), ["id"]).count() == 0
    assert proofread.analyze(source(spark)).count() == 0 and isinstance(pd.DataFrame(), pd.DataFrame)


def test_golden_and_pairs(spark):
    seg = "array<struct<text:string,segment_type:string,speaker:string>>"
    df = spark.createDataFrame([("a", "xy", [("x", "narration", None), ("y", "dialogue", "A")]), ("b", "xy", [("x", "narration", "A")]), ("c", "", [])], f"case_id string, source_text string, segments {seg}")
    assert rows(evaluate.golden_problems(df)) == [("b", "NarrationSpeaker"), ("b", "SourceMismatch"), ("c", "EmptySegment")]
    ids_ = lambda *x: spark.createDataFrame([(i,) for i in x], "case_id string")
    assert rows(evaluate.unpaired(ids_("a", "b", "c"), ids_("b", "c", "c", "d"))) == [("a", "MissingObservation"), ("c", "Duplicate"), ("d", "UnknownCase")]
    at = lambda n: spark.range(1).select(evaluate.nth_occurrence(F.lit("é.a.b."), F.lit("."), F.lit(n)).alias("x")).first()["x"]
    assert [at(n) for n in (1, 2, 3, 4, 0)] == [1, 3, 5, None, None]


def test_signatures_ignore_order_and_evidence(spark):
    schema = "chapter_id string, name string, aliases array<string>, inferred boolean"
    a = spark.createDataFrame([("c", "Ada", ["x", "Y"], False), ("c", "Bo", [], True)], schema)
    b = spark.createDataFrame([("c", "bo ", [], True), ("c", "ADA", ["y", "X"], False), ("d", "Cy", [], True)], schema)
    assert rows(memory.signature_changes(memory.semantic_signatures(a), memory.semantic_signatures(b))) == [("d", "added")]
    seq = spark.createDataFrame([("p", "c", 4), ("p", "d", 2)], "project_id string, chapter_id string, sequence int")
    assert rows(diff.dirty_from(spark.createDataFrame([("c",), ("d",), ("d",)], "chapter_id string"), seq).select("dirty_from")) == [(2,)]


def test_run_means_cover_every_provider(spark, tmp_path):
    from folioframe.plans import story

    runs = [(f"r{i}", f"p{i}" if i else None, "x", i, 10 if i % 2 else None, 1) for i in range(60)]
    df = spark.createDataFrame(runs, "run_id string, provider string, project_id string, total_tokens int, latency_ms bigint, attempt_count int")
    df.withColumn("ingested_at", F.lit("2025-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "llm_runs.parquet"))
    got = {(r["provider"], r["metric"]): r["value"] for r in story.run_means(spark, str(tmp_path)).collect()}
    assert len(got) == 180 and got[("p7", "total_tokens")] == 7 and got[("p8", "latency_ms")] is None and got[(None, "attempts")] == 1


def test_content_hash_frames_every_field_in_order(spark):
    import hashlib

    books = spark.createDataFrame([("b", "T", ["A", "B"], "en", "txt", "x.txt", "00"), ("n", None, None, None, None, None, None)], "book_id string, title string, authors array<string>, lang_label string, source_format string, source_locator string, source_hash string")
    chapters = spark.createDataFrame([("c1", "b", 1, ""), ("c0", "b", 0, "Öne")], "chapter_id string, book_id string, chapter_index int, title string")
    blocks = spark.createDataFrame([("c0", 0, "heading", "Öne", "s", 0, 4, None), ("c0", 1, "paragraph", None, "s", 4, 9, 0.93)], "chapter_id string, block_index int, block_type string, text string, source_id string, start_byte long, end_byte long, extraction_confidence double")
    field = lambda n, v: f"{n}\0{len(v.encode())}:{v}\n"
    head = [("document.id", "b"), ("metadata.title", "T"), ("metadata.authors.count", "2"), ("metadata.author", "A"), ("metadata.author", "B"), ("metadata.language", "en"), ("metadata.source_format", "txt"), ("metadata.source_locator", "x.txt"), ("metadata.source_hash", "00"), ("chapters.count", "2")]
    body = [("chapter.id", "c0"), ("chapter.index", "0"), ("chapter.title", "Öne"), ("chapter.blocks.count", "2"), ("block.type", "heading"), ("block.text", "Öne"), ("block.source_id", "s"), ("block.start_byte", "0"), ("block.end_byte", "4"),
            ("block.type", "paragraph"), ("block.text", ""), ("block.source_id", "s"), ("block.start_byte", "4"), ("block.end_byte", "9"), ("block.extraction_confidence", "%.17g" % 0.93), ("chapter.id", "c1"), ("chapter.index", "1"), ("chapter.title", ""), ("chapter.blocks.count", "0")]
    got = {r["book_id"]: r["content_hash"] for r in document.content_hash(document.nested(books, chapters, blocks)).collect()}
    assert got["b"] == hashlib.sha256("".join(field(n, v) for n, v in head + body).encode()).hexdigest() and len(got["n"]) == 64


def test_real_text_has_seventeen_digits(spark):
    values = [0.93, 0.1, 0.05, 0.02, 0.0123, 0.00456, 0.00078, 1 / 3, 0.999999, 1.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c double").select(document.real_text(F.col("c"))).collect()]
    assert got == ["%.17g" % v for v in values]


def test_linear_space_diff_is_as_short(spark, monkeypatch):
    import random

    rng = random.Random(4)
    for _ in range(60):
        old, new = ("".join(rng.choice(["ä\n", "b\n", "c c\n", "d"]) for _ in range(rng.randint(0, 12))).encode() for _ in range(2))
        monkeypatch.setattr(diff, "MAX_CELLS", 1_000_000)
        whole, capped = diff.hunks(old, new)
        monkeypatch.setattr(diff, "MAX_CELLS", 1)
        linear, still = diff.hunks(old, new, exact=True)
        assert not capped and not still
        for found in (whole, linear):  # what is between hunks is equal, and no character is parted
            out, i = b"", 0
            for s, e, t, u in found:
                out += old[i:s] + new[t:u]
                old[s:e].decode(), new[t:u].decode()
                i = e
            assert out + old[i:] == new
        assert old == new or diff.hunks(old, new)[1]


def test_offsets_at_and_inside_edits(spark):
    points = spark.createDataFrame([("s", p) for p in (0, 2, 3, 5, 9)], "source_id string, point long")
    edits = spark.createDataFrame([("s", 2, 5, 1), ("s", 9, 9, 4), ("t", 0, 1, 7)], "source_id string, old_start long, old_end long, new_len int")
    got = lambda flag: {r["point"]: r["new_point"] for r in diff.mapped_offsets(points, edits, flag).collect()}
    assert got(True) == {0: 0, 2: 2, 3: None, 5: 3, 9: 11} and got(False) == {0: 0, 2: 2, 3: None, 5: 3, 9: 7}


def test_a_metric_of_one_side_is_missing(spark):
    b = spark.createDataFrame([("c", "m", 0.5), ("c", "gone", 0.5)], "case_id string, metric string, value double")
    c = spark.createDataFrame([("c", "m", 0.5), ("c", "new", 0.5)], "case_id string, metric string, value double")
    limits = spark.createDataFrame([("m", 0.1, None, None)], "metric string, minimum double, maximum double, max_ratio double")
    assert {(r["metric"], r["issue"]) for r in evaluate.compare_runs(b, c, limits).collect()} == {("gone", "MissingMetric"), ("new", "MissingMetric")}


def test_memory_ranked_streams_a_copy_of_the_memory(spark, monkeypatch):
    """Relevance as by ``mentions``; no frame of pairs of query and item is written out, and no pair is sorted."""
    monkeypatch.setattr(context, "SHARE", 2)
    people = spark.createDataFrame([("p", "c1", "Ann", ["he"], 1, 0), ("p", "c2", "Bo", ["the old baker"], 1, 3), ("p", "c3", "林", [None], 1, 3), ("q", "c4", "Zed", [], 1, 1)], "project_id string, character_id string, name string, aliases array<string>, n_chapters int, last_sequence int")
    threads = spark.createDataFrame([("p", "t1", "a-b", 0, 20000, True), ("p", "t2", "The Lost Map", 0, 1, False)], "project_id string, thread_id string, thread string, first_sequence int, last_sequence int, inferred_only boolean")
    events = spark.createDataFrame([("p", "e1", 2, "Rain", ["Bo"], ["c2"], None), ("p", "e2", 2, "Snow", [], [], "Harbour")], "project_id string, event_id string, sequence int, description string, participants array<string>, character_ids array<string>, location string")
    asked = [(f"x{i}", "p", t) for i, t in enumerate(["Ann met A-B.", "bakers", "林先生", "nothing", "maps at the HARBOUR", ""])]
    queries = spark.createDataFrame([*asked, ("y", "q", "zed"), ("z", None, "Ann"), ("w", "none", "Ann")], "context_id string, project_id string, query string")
    df = context.ranked(queries, context.items(people, threads, events))
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["context_id"], r["place"])):
        got.setdefault(r["context_id"], []).append((r["stable_id"], r["priority"]))
    rest = {"c1": 100_000, "c2": 100_003, "c3": 100_003, "t1": 59_999, "t2": 50_001, "e1": 200_002, "e2": 200_002}
    found = {"x0": {"c1": 500_000, "t1": 309_999}, "x1": {"c2": 500_003, "e1": 400_002}, "x2": {"c3": 500_003}, "x3": {}, "x4": {"e2": 400_002}, "x5": {}}
    kinds = "cet"
    assert got == {x: sorted((rest | f).items(), key=lambda kv: (-kv[1], kinds.index(kv[0][0]), kv[0])) for x, f in found.items()} | {"y": [("c4", 500_001)]}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "event_id" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_prompts_need_no_ranked_rows(spark):
    """The same prompts as from ranked rows, without a row for every pair of context and item."""
    people = spark.createDataFrame([("p", f"c{i}", f"Name{i} " + "long " * (i % 7), [], 1, i) for i in range(60)], "project_id string, character_id string, name string, aliases array<string>, n_chapters int, last_sequence int")
    threads = spark.createDataFrame([("p", f"t{i}", f"Thread {i}", 0, i, False) for i in range(60)], "project_id string, thread_id string, thread string, first_sequence int, last_sequence int, inferred_only boolean")
    memory = context.items(people, threads)
    made = [("a", "p", 300), ("b", "p", 64), ("c", "p", 1), ("d", None, 300), ("e", "other", None), ("f", "p", 5000)]
    cols = "context_id string, project_id string, query string, system_rules string, background string, terminology array<string>, recent_summary string, current_chapter string, task string, maximum_tokens int, reserved_completion_tokens int"
    contexts = spark.createDataFrame([(c, p, "name7 met name9 on thread 3", "r", None, ["w"], "", "chapter", None, n, 0) for c, p, n in made], cols)
    df = context.prompts(contexts, memory)
    got = rows(df.na.fill("-"))
    assert got == rows(context.build(contexts, context.ranked(contexts, memory)).na.fill("-")) and len(got) == 6
    assert {r[0]: (r[-1], sum(r[4:7]), sum(r[4:10])) for r in got if r[0] in "cf"} == {"c": ("MandatoryContentExceedsBudget", 0, 0), "f": ("-", 120, 120)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "place#" not in plan


def test_name_use_makes_no_pairs_of_events_and_owners(spark):
    """As by trying every owner of a name; overlapping, open and ended times, owners that don't exist yet, shared event ids."""
    import random

    rnd = random.Random(7)
    n = ["a", "b", "c"]
    chars = [(i, rnd.choice(n), rnd.randrange(6000), 0, i % 2) for i in range(12)]
    variants = [(rnd.randrange(14), rnd.choice(n).upper(), f := rnd.randrange(6000), 1, rnd.choice([None, f, f + rnd.randrange(3000)]), 1) for _ in range(40)]
    variants = [(*v, v[0] % 2) for v in variants]
    events = [(i // 2 if i < 40 else i, c := rnd.randrange(14), rnd.choice([*n, "z", None]), rnd.randrange(9000), i % 3, 1.0, c % 2) for i in range(400)]
    ev = spark.createDataFrame(events, "event_id long, character_id long, used_name string, tick long, ord long, confidence double, project_id long")
    ch = spark.createDataFrame(chars, "character_id long, name string, from_tick long, from_ord long, project_id long")
    va = spark.createDataFrame(variants, "character_id long, name string, from_tick long, from_ord long, until_tick long, until_ord long, project_id long")
    exists = {c[0]: c[2:4] for c in chars}
    own, other = {}, {}
    for e, c, u, t, o, _, p in events:
        for w, name, a, b in [*((x[0], x[1], None, None) for x in chars), *((x[0], x[1].lower(), x[2:4], x[4:6] if x[4] is not None else None) for x in variants)]:
            if name == u and w % 2 == p and w in exists and (a is None or a <= (t, o)) and (b is None or (t, o) < b):
                (own if w == c else other if (t, o) >= exists[w] else {})[e] = True
    want = [(e, c, "AMBIGUOUS_NAME_VARIANT" if e in own else "INVALID_NAME_VARIANT") for e, c, u, *_ in events if u and (e not in own or e in other)]
    df = integrity.name_use(ev, ch, va)
    assert rows(df.select("event_id", "character_id", "rule")) == sorted(want) and len({x[2] for x in want}) == 2
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("key#" in x for x in joins)


def test_explained_findings_join_no_names(spark):
    from folioframe.plans import story

    plan = story.explained_findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("key#" in x for x in plan.splitlines() if "Join" in x)


def test_only_findings_of_explained_rules_are_moved(spark):
    """The same as a join of all findings; what no explanation is of stays out of the join, and each rule reads its events once."""
    from folioframe.plans import story

    rules = ["SPEECH_AFTER_DEATH", "UNRESOLVED_LOCATION", None]
    found = spark.createDataFrame([(i // 3, i % 4, rules[i % 3]) for i in range(30)], "event_id long, character_id long, rule string")
    why = spark.createDataFrame([(0, rules[0], "b"), (0, rules[0], "a"), (4, rules[0], None), (5, rules[0], "c"), (77, rules[0], "d")], "event_id long, rule string, reason string")
    plain = lambda d: sorted(map(repr, d.select("event_id", "character_id", "rule", "reason").collect()))
    got = plain(integrity.explain(found, why, (rules[0],)))
    assert got == plain(integrity.explain(found, why)) and len(got) == 30 and sum("reason=None" not in x for x in got) == 2
    lines = story.explained_findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(lines) if "Join" in x and "rule#" in x and "event_id#" in x)
    end = next(i for i, x in enumerate([*lines, ""]) if i > at and depth(x) <= depth(lines[at]))
    assert not any("VARIANT" in x or "UNRESOLVED" in x for x in lines[at + 1 : end])
    assert sum("Repartition" in x for x in lines) == 6 and sum("Relation" in x for x in lines) < 30


def test_speaker_before_takes_part_in_the_events_of_prompts(spark, tmp_path):
    """The speaker before the first one of an event takes part in it, and makes it relevant; narration is passed over, the chapter before is not looked at."""
    told = [(1, "c1", 0, "One", "Ann"), (2, "c1", 1, "two", None), (3, "c1", 3, "three", "Bo"), (4, "c1", 4, "Four", None), (5, "c1", 6, "six", "Cid"), (6, "c1", 9, "Nine", "Cid"), (7, "c2", 0, "Ten", "Dee")]
    tables = {
        "segments": ([(i, "p", c, n, t, s, d) for i, c, n, t, s in told for d in range(1 + (i == 5))], "segment_id long, project_id string, chapter_id string, segment_index int, text string, speaker string, ingested_at int"),
        "chapters": ([("c1", "b", 0, None), ("c2", "b", 1, None)], "chapter_id string, book_id string, chapter_index int, title string"),
        "books": ([("b", "p", None, 0)], "book_id string, project_id string, lang_label string, ingested_at int"),
        "analysis_characters": ([(1, "p", "c1", "Bobby", ["Bo"], False, 1.0, 0)], "record_id long, project_id string, chapter_id string, character_name string, aliases array<string>, inferred boolean, confidence double, ingested_at int"),
        "context_inputs": ([("x", "p", "r", "b", ["w"], "s", "Bobby came.", "t", 1000, 0, 0)], "context_id string, project_id string, system_rules string, background string, terminology array<string>, recent_summary string, current_chapter string, task string, maximum_tokens int, reserved_completion_tokens int, ingested_at int"),
    }
    for name, (data, cols) in tables.items():
        spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    base = dict(system_rules="r", background="b", terminology=["w"], recent_summary="s", current_chapter="Bobby came.", task="t")
    events = ["Chapter 1: One | participants: Bobby, Ann", "Chapter 1: Four | participants: Bobby, Cid", "Chapter 2: Ten | participants: Dee", "Chapter 1: Nine | participants: Cid"]
    want = context.render(base, {"character": ["Bobby | aliases: Bo | seen in 1 chapter(s), last in chapter 1"], "event": events, "thread": []})
    got = story.context_prompts(spark, str(tmp_path)).first()
    assert (got["n_events"], got["omitted_events"], got["estimated_tokens"], got["prompt"]) == (4, 0, context.estimate(want), hashlib.sha256(want.encode()).hexdigest())
