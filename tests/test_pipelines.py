import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tessella import pipelines, sinks, sources
from tessella.functions import text as T
from tessella.operators import transforms


def test_convert_translate_merge(spark, tmp_path):
    (tmp_path / "a.properties").write_text("k=One. Two.\nz=Three\n")
    (tmp_path / "b.html").write_text("<html><p>Four. <b>Five</b>.</p></html>")
    parts, segments = pipelines.convert(spark, str(tmp_path), "en")
    assert sorted(r.source for r in segments.collect()) == [" <b>Five</b>.", " Two.", "Four.", "One.", "Three"]
    same = {r.doc_id[-4:]: r.text for r in pipelines.merge(parts, segments).collect()}
    assert same == {"ties": "k=One. Two.\nz=Three\n", "html": "<html><p>Four. <b>Five</b>.</p></html>"}
    done = transforms.approve_all(transforms.pseudo_translate(segments))
    changed = {r.doc_id[-4:]: r.text for r in pipelines.merge(parts, done).collect()}
    assert changed["ties"] == "k=Önè. Twö.\nz=Thrèè\n"


def test_reports(spark):
    rows = [("f", k, s, t, a, True, m, None) for k, (s, t, a, m) in enumerate([("a b", "x", True, []), ("a b", "x", True, []), ("c", None, False, [("tm", "100", "c", "d")]), ("d", None, False, [])])]
    seg = spark.createDataFrame(rows, "original string, pos int, source string, target string, approved boolean, translate boolean, matches array<struct<origin:string,quality:string,source:string,target:string>>, state_qualifier string")
    out = pipelines.analyse(seg, "en")
    total = out["segments"].where("original = 'SUM'").first()
    assert (total.n_new, total.n_rep_int, total.n_matches, total.n_total) == (2, 1, 1, 4)
    words = out["words"].where("original = 'f'").first()
    assert (words.w_new, words.w_repeated, words.w_exact, words.w_total) == (3, 2, 1, 6)
    assert out["status"].where("original = 'f'").first().segments_approved == 2
    assert out["chart"].count() == 4
    assert "<td>SUM</td>" in sinks.html_table(out["segments"], "t", "original").first()[0]
    assert sinks.bar_chart(out["chart"], "original", "quality").first()["svg"].count("<rect") == 4


def test_writers(spark):
    seg = spark.createDataFrame([("d", "f.txt", 0, "1", "a & <b>", "A", True, True, None, 0), ("d", "f.txt", 1, "2", "c", None, False, True, None, 0)], "doc_id string, original string, pos int, unit_id string, source string, target string, approved boolean, translate boolean, state string, file_no int")
    one = sinks.xliff_1(seg, "en", "es").first()["text"]
    two = sinks.xliff_2(seg, "en", "es").first()["text"]
    tmx = pipelines.export_tmx(seg, "en", "es").first()["text"]
    for text in (one, two, tmx):
        ET.fromstring(text.encode())
    [(_, parts)] = sources.parse(one.encode(), "XLIFF")
    assert [(p.unit, p.source, p.target, p.approved) for p in parts if p.unit is not None] == [("1", "a &amp; &lt;b&gt;", "A", True), ("2", "c", None, False)]
    [(_, parts)] = sources.parse(two.encode(), "XLIFF")
    assert [(p.source, p.target, p.state) for p in parts if p.unit is not None] == [("a &amp; &lt;b&gt;", "A", "final"), ("c", None, "initial")]
    h = 0
    for c in "f.txt":
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    h -= (h >= 1 << 31) << 32
    assert tmx.count("<tu ") == 1 and f'tuid="{h}-0-49"' in tmx


def test_names(spark):
    df = spark.createDataFrame([("x/a.txt", "es", 1), ("x/p.sdlppx", "es", 1), ("x/a.txt", "es", 2)], "p string, l string, n int")
    assert [r[0] for r in df.select(sinks.target_name(F.col("p"), F.col("l"), F.col("n"))).collect()] == ["x/a_es.txt", "x/p_es.sdlrpx", "x/es"]
    df = spark.createDataFrame([("a/b/c.xml", "a/d/e.xml"), ("a/c.xml", "a/e.xml")], "h string, p string")
    assert [r[0] for r in df.select(sinks.relative_path(F.col("h"), F.col("p"))).collect()] == ["../d/e.xml", "e.xml"]
    links = spark.createDataFrame([("m", "GUID-12AB.xml#x"), ("m", "other.xml")], "file string, href string")
    files = spark.createDataFrame([("t/GUID-12AB=1=en.xml",)], "path string")
    assert {r.href for r in pipelines.fix_references(links, files).collect()} == {"t/GUID-12AB=1=en.xml#x", "other.xml"}


def test_more_functions(spark):
    one = lambda t, f: spark.createDataFrame([(t,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("a &lt;b&gt; &#233;&#x4e2d; &amp;lt; &zz;", T.decode_entities) == "a <b> é中 &lt; &zz;"
    assert [one(t, T.tags_balanced) for t in ("<b>x<i>y</i></b>", "<b>x<i>y</b></i>", "<br/>x", "x</b>", "1 < 2")] == [True, False, True, False, True]


def test_command_line(spark, tmp_path):
    from tessella.__main__ import parser, run

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.properties").write_text("k=One. Two.\n")
    go = lambda *args: run(spark, parser().parse_args([str(x) for x in args]))
    go("convert", "-file", tmp_path / "in", "-srcLang", "en", "-out", tmp_path / "t")
    go("pseudotranslate", "-segments", tmp_path / "t/segments", "-out", tmp_path / "p")
    go("approveall", "-segments", tmp_path / "p", "-out", tmp_path / "m/segments")
    spark.read.parquet(str(tmp_path / "t/parts")).write.parquet(str(tmp_path / "m/parts"))
    go("merge", "-tables", tmp_path / "m", "-out", tmp_path / "out")
    assert spark.read.parquet(str(tmp_path / "out")).first()["text"] == "k=Önè. Twö.\n"
    go("exporttmx", "-segments", tmp_path / "m/segments", "-srcLang", "en", "-tgtLang", "es", "-out", tmp_path / "tmx")
    assert spark.read.parquet(str(tmp_path / "tmx")).first()["text"].count("<tu ") == 2
    go("compare", "-file1", tmp_path / "p", "-file2", tmp_path / "m/segments", "-out", tmp_path / "diff")
    assert spark.read.parquet(str(tmp_path / "diff")).count() == 0


MERGED = {
    "a.properties": ("k=v\n", "line\nbreak 中", "k=line\\nbreak \\u4e2d\n"),
    "b.json": ('{"a": "v"}', 'say "x"\n\\ 中', '{"a": "say \\"x\\"\\n\\\\ 中"}'),
    "c.php": ("<?php\nreturn array('k' => 'v', 3 => [1, \"n\" => true]);", "it's \"x\"", "<?php\nreturn array('k' => 'it\\'s \"x\"', 3 => [1, \"n\" => true]);"),
    "d.php": ('<?php\nreturn array("k" => "v");', "it's \"x\"", '<?php\nreturn array("k" => "it\'s \\"x\\"");'),
    "e.mif": ("<Para\n<ParaLine\n<String `v'>\n>\n>\n", "a`b'c>\t\\", "<Para\n<ParaLine\n<String `a\\Qb\\qc\\>\\t\\\\'>\n>\n>\n"),
}


def test_merge_encodes_by_format(spark):
    kinds = {"properties": "JAVA", "json": "JSON", "php": "PHPA", "mif": "MIF"}
    for kind in sorted(set(kinds)):
        docs = [(n, t.encode("utf-8")) for n, (t, _, _) in MERGED.items() if n.endswith(kind)]
        parts = sources.parts_of(spark.createDataFrame(docs, "path string, content binary"), kinds[kind])
        segments = sources.segments_of(parts)
        assert [r.source for r in segments.collect()] == ["v"] * len(docs)
        same = {r.doc_id: r.text for r in pipelines.merge(parts, segments).collect()}
        assert same == {n: MERGED[n][0] for n, _ in docs}
        said = F.create_map(*[F.lit(x) for n, _ in docs for x in (n, MERGED[n][1])])
        done = segments.withColumns({"target": said[F.col("doc_id")], "approved": F.lit(True)})
        changed = {r.doc_id: r.text for r in pipelines.merge(parts, done).collect()}
        assert changed == {n: MERGED[n][2] for n, _ in docs}


def test_two_segments_of_one_place_and_no_content(spark):
    parts = sources.parts_of(spark.createDataFrame([("a", b"k=v\n"), ("b", None)], "path string, content binary"), "JAVA")
    assert [(r.doc_id, r.error) for r in parts.where("kind = 'error'").collect()] == [("b", "no content")]
    segments = sources.segments_of(parts)
    with pytest.raises(Exception, match="two segments of one place"):
        sources.merge_text(parts, segments.unionAll(segments)).collect()
