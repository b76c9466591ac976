"""Markup with quoted signs, comments and literal text; names of files; files in folders of recordings."""

from voxtable.functions import text as X
from voxtable.operators import segments
from voxtable.sources import readers

HEAD = "<Trans><Speakers><Speaker id='s1' name=\"A &gt; B\"/><Speaker name='C' id=\"s2\" /></Speakers><Episode><Section startTime='0'>"
CASES = {
    "sign in a value": ('<Turn speaker="s1" startTime="0" endTime="5"><Sync time="0"/>one<Event desc="x > y"/>two</Turn>', [("A > B", 0.0, 5.0, "one two")]),
    "single quotes": ("<Turn speaker='s1' startTime='0' endTime='5'><Sync time='0'/>a 'b' > c</Turn>", [("A > B", 0.0, 5.0, "a 'b' > c")]),
    "a name inside a value": ('<Turn speaker="s1" startTime="0" endTime="5"><Sync time="0"/>a<Event desc=\'see time="3" there\'/>b</Turn>', [("A > B", 0.0, 5.0, "a b")]),
    "comment with tags": ('<Turn speaker="s1" startTime="0" endTime="5"><Sync time="0"/>a<!-- <Sync time="2"/> </Turn> -->b</Turn>', [("A > B", 0.0, 5.0, "ab")]),
    "literal text": ('<Turn speaker="s2" startTime="0" endTime="5"><Sync time="0"/><![CDATA[x < y && "z" </Turn>]]></Turn>', [("C", 0.0, 5.0, 'x < y && "z" </Turn>')]),
    "tag with an end": ('<Turn speaker="s1" startTime="0" endTime="5"><Sync time="0"></Sync>a<Comment desc="n">inside</Comment>b</Turn>', [("A > B", 0.0, 5.0, "a b")]),
    "end tag in a value": ('<Turn speaker="s1" startTime="0" endTime="5"><Sync time="0"/>a<Event desc="</Turn>"/>b</Turn>', [("A > B", 0.0, 5.0, "a b")]),
    "no length": ('<Turn speaker="s1" startTime="5" endTime="5"><Sync time="5"/>gone</Turn><Turn speaker="s1" startTime="5" endTime="7">kept</Turn>', [("A > B", 5.0, 7.0, "kept")]),
}


def test_cases(spark):
    files = spark.createDataFrame([(k, f"{HEAD}{body}</Section><Section>between</Section></Episode></Trans>") for k, (body, _) in CASES.items()], "rec_id string, value string")
    tokens, names = segments.trs_tokens(files)
    got = {}
    for r in segments.rebuild(tokens, names).orderBy("rec_id", "turn", "pos").collect():
        got.setdefault(r.rec_id, []).append((r.speaker, r.start, r.end, r.text))
    assert {k: [(s, a, b, t) for s, a, b, t in v] for k, v in got.items()}.keys() == CASES.keys()
    for name, (_, want) in CASES.items():
        assert [(got[name][0][0], got[name][0][1], got[name][-1][2], " ".join(t for *_, t in got[name]))] == want, name
    assert segments.markup_errors(tokens).count() == 0


def test_files_with_spaces_and_accents(spark, tmp_path):
    for number, name in ((7, "Rec é. a b.trs"), (12, "50% + x.trs")):
        folder = tmp_path / f"record-{number:02d} été"
        folder.mkdir()
        (folder / name).write_text(f"{HEAD}{CASES['sign in a value'][0]}</Section></Episode></Trans>", encoding="utf-8")
    files = readers.whole_files(spark, str(tmp_path), "*.trs")
    assert sorted(r.name for r in files.collect()) == ["50% + x", "Rec é. a b"]
    assert "Rec_e__a_b" in {r.x for r in files.select(X.recording_id("name").alias("x")).collect()}
    annotated = readers.annotation_files(spark, str(tmp_path))
    tokens, names = segments.trs_tokens(annotated)
    assert sorted((r.rec_id, r.text) for r in segments.merge(segments.rebuild(tokens, names)).collect()) == [("record-007", "one two"), ("record-012", "one two")]
    (tmp_path / "a.xml").write_text('<d><s id="1 > 0"><w id="x>y">Bon</w><w>jour</w><time id=\'a>b\'/></s></d>')
    assert [r.text for r in readers.subtitle_sentences(readers.whole_files(spark, str(tmp_path), "*.xml")).collect()] == ["Bon jour"]
