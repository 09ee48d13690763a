"""Each format: what is found, and that documents come together again."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella import sources as S, srx
from tessella.sources import detect as D, lines, markup, packages
from tessella.sources.core import ENCODERS

CASES = {
    "TEXT": ("a b\nc\n\n\nd e\n \nf\n", ["a b\nc", "d e", "f"]),
    "JAVA": ("# c\nk=v\\u4e2d\n\nbad\nx=\n", ["v中"]),
    "SRT": ("1\n00:00 --> 00:01\nHi <i>x</i>\nyou\n\n2\n00:01 --> 00:02\nBye\n", ["Hi <i>x</i>\nyou", "Bye"]),
    "JS": ('var a = "x\\"y"; // "c"\nb = \'z\' + "" + 3/2;\n', ['x\\"y', "z"]),
    "PHPA": ("<?php\nreturn array('k' => 'v', \"b\" => \"w\");", ["v", "w"]),
    "RC": ('#include "a.h"\nSTRINGTABLE\nBEGIN\n IDS_A "Hello"\n IDS_B ""\nEND\n', ["Hello"]),
    "JSON": ('{"a": "x\\n", "b": [1, "y", {"c": ""}]}', ["x\n", "y"]),
    "HTML": ('<html><body><p><b>Hi</b> there</p><script>var t="</p>";</script><!-- x --><div><p>2</p></div></body></html>', ["<b>Hi</b> there", "2"]),
    "XML": ('<?xml version="1.0"?><r><p>a <b>c</b> d</p><q/></r>', ["a <b>c</b> d"]),
    "INX": ("<docu><pcnt>c_a~sep~b</pcnt><x>e_1</x></docu>", ["a_b"]),
    "ICML": ("<Story><Content>a</Content><Change ChangeType=\"DeletedText\"><Content>gone</Content></Change></Story>", ["a"]),
    "RESX": ('<root><data name="a"><value>T</value></data><data name="b" type="x"><value>U</value></data><data name=">>c"><value>W</value></data></root>', ["T"]),
}


@pytest.mark.parametrize("format", sorted(CASES))
def test_monolingual(format):
    text, want = CASES[format]
    [(_, parts)] = S.parse(text.encode("latin-1" if format == "JAVA" else "utf-8"), format)
    assert [p.source for p in parts if p.unit is not None] == want
    encode = ENCODERS.get(format, lambda x: x)
    assert "".join(p.literal if p.unit is None else encode(p.source) for p in parts) == text
    assert [p.unit for p in parts if p.unit is not None] == [str(k) for k in range(len(want))] or format == "SRT"


BILINGUAL = {
    "PO": ('msgid ""\nmsgstr "H\\n"\n\n#, fuzzy, c-format\nmsgctxt "c"\nmsgid "a %d"\nmsgid_plural "b"\nmsgstr[0] "x"\nmsgstr[1] ""\n', [("", "H\\n", True), ("a %d", "x", False), ("b", None, False)]),
    "TS": ('<TS><message><source>a</source><translation type="unfinished">b</translation></message><message><source>c</source><translation>d</translation></message></TS>', [("a", "b", False), ("c", "d", True)]),
    "TXML": ('<txml ><segment segmentId="1"><source>a</source><target>b</target></segment></txml>', [("a", "b", False)]),
    "TXLF": ('<xliff><trans-unit id="1"><source>a</source><target state="translated">b</target></trans-unit><trans-unit id="2" translate="no"><source>a</source><target>b</target></trans-unit></xliff>', [("a", "b", True)]),
    "SDLXLIFF": ('<xliff><trans-unit id="u"><seg-source><mrk mtype="seg" mid="1">a</mrk></seg-source><target><mrk mtype="seg" mid="1">x</mrk></target><sdl:seg id="1" conf="ApprovedSignOff" locked="true"/></trans-unit></xliff>', [("a", "x", True)]),
    "XLIFF": ('<xliff version="1.2"><file><body><trans-unit id="1" approved="yes"><source>a</source><target>b</target></trans-unit></body></file></xliff>', [("a", "b", True)]),
}


@pytest.mark.parametrize("format", sorted(BILINGUAL))
def test_bilingual(format):
    text, want = BILINGUAL[format]
    [(_, parts)] = S.parse(text.encode(), format)
    assert [(p.source, p.target, p.approved) for p in parts if p.unit is not None] == want
    assert "".join(p.literal if p.unit is None else p.target or "" for p in parts) == text


def test_version_2_and_wpml():
    text = '<xliff version="2.0"><file id="f"><unit id="1"><segment id="s" state="final"><source>a</source><target>b</target></segment><ignorable><source> </source></ignorable><segment><source>c</source></segment></unit></file></xliff>'
    [(_, parts)] = S.parse(text.encode(), "XLIFF")
    assert [(p.unit, p.source, p.target, p.state) for p in parts if p.unit is not None] == [("0/1/s", "a", "b", "final"), ("0/1/2", "c", None, "initial")]
    [(_, parts)] = S.parse(b'<xliff ><trans-unit id="1" resname="r"><source><![CDATA[a\nb]]></source><target><![CDATA[]]></target></trans-unit></xliff>', "WPML")
    assert [p.source for p in parts if p.unit is not None] == ["a", "b"]


def test_frame_maker():
    text = "<MIFFile 9>\n<Para\n <ParaLine\n  <String `Hello \\q x'>\n  <Font\n  > # end\n  <String `y'>\n > # end\n> # end of Para\n"
    [(_, parts)] = S.parse(text.encode(), "MIF")
    [p] = [p for p in parts if p.unit is not None]
    assert p.source.startswith("Hello ' x<ph>") and p.source.endswith("y")


def test_configured():
    config = markup.Config(segment=frozenset({"text", "title"}), inline=frozenset({"tspan"}), attributes={"image": frozenset({"alt"})})
    parts = markup.xml_document('<svg><text>a <tspan>b</tspan></text><image alt="pic"/><g>no</g></svg>', config)
    assert [p.source for p in parts if p.unit is not None] == ["a <tspan>b</tspan>", "pic"]
    got = lines.json_configured('[{"s": "a", "t": "b", "i": "1", "x": "skip", "y": "more"}, "z"]', [{"sourceKey": "s", "targetKey": "t", "idKey": "i"}], ("x",))
    assert got == [{"source": "a", "target": "b", "id": "1"}, {"source": "more", "resname": "y"}, {"source": "z"}]


def package(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_packages():
    docx = package(**{"[Content_Types].xml": "<Types/>", "word/document.xml": "<w:document><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p><w:p><w:r><w:t>12.5</w:t></w:r></w:p></w:document>"})
    assert D.detect(docx) == "OFF"
    [(name, parts)] = S.parse(docx, "OFF")
    assert name == "word/document.xml" and [p.source for p in parts if p.unit is not None] == ["Hello</w:t></w:r><w:r><w:t> you"]
    pptx = package(**{"[Content_Types].xml": "", **{f"ppt/{k}": f"<a:p><a:t>{k}</a:t></a:p>" for k in ("slides/slide10.xml", "slides/slide2.xml", "notesSlides/notesSlide1.xml", "slideMasters/slideMaster1.xml")}})
    assert [n for n, _ in S.parse(pptx, "OFF")] == ["ppt/slides/slide2.xml", "ppt/slides/slide10.xml", "ppt/notesSlides/notesSlide1.xml"]
    odt = package(**{"content.xml": "<office><text:p>a <text:span>b</text:span></text:p></office>"})
    assert D.detect(odt) == "OO" and S.parse(odt, "OO")[0][1][1].source == "a <text:span>b</text:span>"
    idml = package(**{"designmap.xml": '<x src="Stories/Story_2.xml"/><x src="Stories/Story_1.xml"/>', "Stories/Story_1.xml": "<Content>one</Content>", "Stories/Story_2.xml": "<Content>two</Content>", "Stories/Story_3.xml": "<Content>three</Content>"})
    assert D.detect(idml) == "IDML" and [n for n, _ in S.parse(idml, "IDML")] == ["Stories/Story_2.xml", "Stories/Story_1.xml"]
    sdl = package(**{"p.sdlproj": '<LanguageDirection TargetLanguageCode="es-ES" SourceLanguageCode="en-US" />', "es-ES/a.sdlxliff": BILINGUAL["SDLXLIFF"][0]})
    assert D.detect(sdl) == "SDLPPX" and packages.package_languages(sdl) == [("en-US", "es-ES")] and len(S.parse(sdl, "SDLPPX")) == 1
    qti = package(**{"imsmanifest.xml": "<m/>", "item.xml": '<?xml version="1.0"?><item><p>q</p></item>'})
    assert D.detect(qti) == "QTIP" and [n for n, _ in S.parse(qti, "QTIP")] == ["item.xml"]
    with pytest.raises(ValueError):
        packages.qti_package(odt)
    back = package(**{"p.sdlproj": '<PackageProject PackageType="ProjectPackage"/>', "es/a.sdlxliff": "x"})
    assert dict(packages.entries(packages.return_package(back, {"es/a.sdlxliff": "y"}))) == {"p.sdlproj": b'<PackageProject PackageType="ReturnPackage"/>', "es/a.sdlxliff": b"y"}
    again = packages.rebuild(odt, {"content.xml": "<new/>"})
    assert dict(packages.entries(again)) == {"content.xml": b"<new/>"}


@pytest.mark.parametrize("head,code", [
    ("<MIFFile 9>", "MIF"), ('<a x="http://www.imsglobal.org/q"/>', "QTI"), ("<xliff xmlns:sdl='x'>", "SDLXLIFF"), ("<xliff xmlns:gs4tr='x'>", "TXLF"), ("<xliff ><![CDATA[x]]></xliff>", "WPML"), ("<xliff version='1.2'/>", "XLIFF"), ("<?php return [", "PHPA"),
    ("<?xml?><txml >", "TXML"), ("<?xml?><?aid x?><docu>", "INX"), ("<?xml?><root xmlns:msdata=''>", "RESX"), ("<?xml?><!DOCTYPE TS>", "TS"), ("<?xml?><map>", "DITA"), ("<?xml?><Document >", "ICML"), ("<?xml?><x/>", "XML"), ("<svg/>", "XML"), ("<!DOCTYPE html>", "HTML"),
    ("msgid \"a\"\nmsgstr \"\"", "PO"), ("x <HTML>", "HTML"), ("STRINGTABLE", "RC"), ("1\n00:00:01 --> 00:00:02\nMENU", "RC"), ("<a/>", "XML"), ("1\n00:00:01 --> 00:00:02\nhi", "SRT"), ('{"a": 1}', "JSON"), ("plain", None), ("<MIFFile MENU", "MIF"),
])
def test_detection(spark, head, code):
    assert D.detect(head.encode()) == code
    if head != "<a/>":
        assert spark.createDataFrame([(head,)], "t string").select(D.detect_text(F.col("t"))).first()[0] == code


def test_encodings():
    assert D.encoding_of(b"\xef\xbb\xbf{}", "JSON") == "utf-8-sig"
    assert D.encoding_of(b'<meta charset="ISO-8859-1">', "HTML") == "iso-8859-1"
    assert D.encoding_of(b"#pragma code_page(1252)", "RC") == "cp1252"
    assert D.encoding_of(b'<?xml version="1.0" encoding="UTF-16"?>', "XML") == "utf-16"
    assert D.encoding_of(b"x", "TEXT") is None and D.encoding_of(b"x", "JAVA") == "iso-8859-1"


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.properties").write_text("k=v\n")
    (tmp_path / "b.html").write_text("<html><p>x</p></html>")
    (tmp_path / "c.bin").write_bytes(b"\0\1")
    parts = S.read(spark, str(tmp_path))
    assert {r.source for r in S.segments_of(parts).collect()} == {"v", "x"}
    assert parts.where("kind = 'error'").count() == 1
    texts = {r.text for r in S.merge_text(parts, S.segments_of(parts)).collect()}
    assert texts == {"k=v\n", "<html><p>x</p></html>"}


def test_rules():
    s = srx.segmenter(srx.DEFAULT, "en-US")
    assert s.segment("Hello Dr. Smith. How are you? 3.5 is") == ["Hello Dr. Smith.", " How are you?", " 3.5 is"]
    assert s.segment("") == [] and "".join(s.segment("a. b.\n c")) == "a. b.\n c"
    assert s.segment_tagged("Hi <b>x. </b>You.") == ["Hi <b>x.", " </b>You."]
    assert srx.segmenter(srx.DEFAULT, "ja").segment("一。二") == ["一。", "二"]
    only = srx.Rules((("a", (srx.Rule(True, "x", ""),)), ("b", (srx.Rule(True, "y", ""),))), (("en", "b"), (".*", "a")), cascade=False)
    assert srx.Segmenter(only.of("en")).segment("axbyc") == ["axby", "c"]


def test_rule_file(tmp_path, spark):
    p = tmp_path / "r.srx"
    p.write_text('<srx version="2.0" xmlns="http://www.lisa.org/srx20"><header cascade="yes"/><body><languagerules><languagerule languagerulename="d"><rule break="no"><beforebreak>Mr\\.</beforebreak><afterbreak>\\s</afterbreak></rule><rule><beforebreak>\\.</beforebreak><afterbreak>\\s</afterbreak></rule></languagerule></languagerules><maprules><languagemap languagerulename="d" languagepattern=".*"/></maprules></body></srx>')
    r = srx.load(str(p))
    assert srx.Segmenter(r.of("en")).segment("Mr. A. B") == ["Mr. A.", " B"]
    assert srx.rules_table(spark, r).count() == 2
    df = spark.createDataFrame([("Mr. A. B", "en"), (None, "en")], "t string, l string")
    assert [x[0] for x in df.select(srx.segment(F.col("t"), F.col("l"), r)).collect()] == [["Mr. A.", " B"], None]


def test_stream(spark, tmp_path):
    from tessella.streaming import status

    src = tmp_path / "in"
    spark.sql("select id as event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) as ts, 'a' as event_type from range(30)").write.parquet(str(src))
    q = status.watch(spark, str(src), "event_id long, ts timestamp, event_type string").writeStream.outputMode("complete").format("memory").queryName("history").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("history").collect()) == [6, 24]


def test_dialog_data():
    text = 'IDD DLGINIT\nBEGIN\n    IDC_COMBO, 0x403, 6, 0\n0x6548, 0x6c6c, 0x006f,\n    0\nEND\n'
    assert lines.dialog_strings(text) == ["Hello"]
    changed = lines.replace_dialog_strings(text, ["Hola"])
    assert lines.dialog_strings(changed) == ["Hola"] and "0x403, 6, 0" in changed
    for said in ("", "a", "ab", "caf\u00e9"):
        assert lines.words_to_text(lines.text_to_words(said)) == said


def test_frame_maker_comes_together_again():
    text = "<Para\n<ParaLine\n<String `a \\q b'>\n<Font x>\n<String `y'>\n>\n> # end of Para\n"
    [(_, parts)] = S.parse(text.encode(), "MIF")
    assert "".join(p.literal if p.unit is None else ENCODERS["MIF"](p.source) for p in parts) == text
