import pytest
from pyspark.sql import functions as F

from tessella.operators import analysis as A, constraints as C, graph as G, relations as R, transforms as X

UNIT = "original string, pos int, unit_id string, source string, target string, translate boolean, approved boolean, state string, state_qualifier string"


def units(spark, *rows):
    return spark.createDataFrame([(o, p, str(p), s, t, tr, a, None, None) for o, p, s, t, tr, a in rows], UNIT)


def test_repetitions(spark):
    rows = [("A.txt", 0, "x", "new"), ("A.txt", 1, "x", "new"), ("b.txt", 0, "x", "new"), ("b.txt", 1, "x", "exact"), ("b.txt", 2, "y", "new"), ("b.txt", 3, "y", "new")]
    df = spark.createDataFrame(rows, "original string, pos int, key string, type string").repartition(3)
    got = {(r.original, r.pos): r.type for r in A.classify_repetitions(df, ["key"]).collect()}
    assert got[("A.txt", 0)] == "new" and got[("A.txt", 1)] == "rep-int" and got[("b.txt", 0)] == "rep-ext"
    assert got[("b.txt", 2)] == "new" and got[("b.txt", 3)] == "rep-int"
    report = {r.original: r for r in A.segment_report(A.classify_repetitions(df, ["key"])).collect()}
    assert report["SUM"].n_total == 6 == sum(report["SUM"][c] for c in ("n_new", "n_ice", "n_matches", "n_rep_int", "n_rep_ext"))


def test_ice(spark):
    old = units(spark, ("f", 0, "a", "A", True, True), ("f", 1, "b", "B", True, True), ("f", 2, "c", "C", True, True), ("f", 3, "b", "B2", True, True), ("f", 4, "c", "C2", True, False))
    new = units(spark, ("f", 0, "a", None, True, False), ("f", 1, "b", None, True, False), ("f", 2, "c", None, True, False), ("g", 0, "a", None, True, False))
    got = {(r.original, r.pos): r.target for r in R.in_context_matches(old, new).collect()}
    # the last new segment has no next, so the old one's next isn't looked at
    assert got == {("f", 0): "A", ("f", 1): "B", ("f", 2): "C", ("g", 0): None}


def test_transforms(spark):
    df = units(spark, ("f", 0, "ab", None, True, False), ("f", 1, "ab", "", True, False), ("f", 2, "ab", "x", True, False), ("f", 3, "ab", "x", False, False))
    by = lambda d, c: [r[c] for r in d.orderBy("pos").collect()]
    assert by(X.approve_all(df), "approved") == [False, False, True, False]
    assert by(X.approve_all(df, True), "approved") == [False, True, True, True]
    assert by(X.copy_sources(df), "target") == ["ab", "", "x", "x"]
    assert by(X.pseudo_translate(df), "target") == ["áb", "áb", "x", "x"]
    assert by(X.remove_targets(X.copy_sources(df)), "target") == [None] * 4
    twice = X.approve_all(X.approve_all(df))
    assert twice.collect() == X.approve_all(df).collect()


def test_versions(spark):
    seg = spark.createDataFrame([("u", 0, "A. ", "X. ", False, "final"), ("u", 1, " ", None, True, None), ("u", 2, "B.", "Y.", False, "initial"), ("v", 0, "C", None, False, "initial")], "u string, seg_no int, source string, target string, is_ignorable boolean, state string")
    got = {r.u: r for r in X.to_version_1(seg, ["u"]).collect()}
    assert (got["u"].source, got["u"].target, got["u"].approved) == ("A.  B.", "X.  Y.", True)
    assert (got["v"].target, got["v"].approved) == (None, False)


def test_merge_and_policies(spark):
    parts = spark.createDataFrame([("d", 0, "literal", "<", None), ("d", 1, "ref", None, "1"), ("d", 2, "literal", "|", None), ("d", 3, "ref", None, "2")], "doc_id string, part_no int, kind string, literal string, ref_id string")
    seg = spark.createDataFrame([("d", "1", "a", "A", True), ("d", "2", "b", "B", False)], "doc_id string, unit_id string, source string, target string, approved boolean")
    text = lambda p, s=seg: R.merge_documents(parts, s, p).first()["text"]
    assert text("approved") == "<A|b" and text("always") == "<A|B"
    assert R.merge_documents(parts, seg.withColumn("skeleton_target", F.lit("?")), "keep_original").first()["text"] == "<A|?"
    with pytest.raises(Exception, match="segment missing"):
        text("approved", seg.where("unit_id = '1'"))
    with pytest.raises(Exception, match="without target"):
        text("strict", seg.withColumn("target", F.lit(None).cast("string")))


@pytest.mark.parametrize("paths,root", [(["a/b", "a/c"], "a"), (["a/b"], "a"), (["x/y/z", "x/y/w/q"], "x/y"), (["a", "b"], "")])
def test_tree_root(spark, paths, root):
    assert spark.createDataFrame([(paths,)], "p array<string>").select(R.tree_root(F.col("p"))).first()[0] == root


def test_join_and_compare(spark):
    make = lambda *o: spark.createDataFrame([(k, x, "1.2", "en", "es") for k, x in enumerate(o)], "file_no int, original string, version string, src_lang string, tgt_lang string")
    got = R.join_files([make("p/a", "p/b"), make("p/c")]).orderBy("file_no").collect()
    assert [(r.file_no, r.original) for r in got] == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        R.join_files([make("a"), make("b").withColumn("version", F.lit("2.0"))])
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "z")], "k int, v string")
    assert sorted(tuple(r) for r in R.compare(a, b, ["k"], ["v"]).collect()) == [(1, "changed"), (3, "only_a"), (4, "only_b")]


V1 = {"files": "doc_id string, version string, date string, source_lang string, target_lang string", "units": "doc_id string, unit_id string, group_id string, phase string, xid string, source_xml_lang string, target_xml_lang string", "tags": "doc_id string, unit_id string, side string, kind string, id string, rid string, pos string, mid string"}


@pytest.mark.parametrize("rule,change", [
    (None, {}), ("version", {"files": [("d", "9", None, "en", None)]}), ("date", {"files": [("d", "1.2", "2024-13-01T00:00:00Z", "en", None)]}), ("source_language", {"files": [("d", "1.2", None, "??", None)], "units": [("d", "1", None, None, None, None, None)]}),
    ("source_agrees", {"units": [("d", "1", None, None, None, "fr", None)]}), ("unit_unique", {"units": [("d", "1", None, None, None, None, None)] * 2}), ("xid", {"units": [("d", "1", None, None, "7", None, None)]}),
    ("tag_id", {"tags": [("d", "1", "source", "bx", None, None, None, None)]}), ("bx_ex", {"tags": [("d", "1", "source", "bx", "1", None, None, None)]}), ("bpt_ept", {"tags": [("d", "1", "target", "ept", "1", None, None, None)]}),
    ("it_balance", {"tags": [("d", "1", "source", "it", "1", None, "open", None)]}),
    ("it_once", {"tags": [("d", "1", "source", "it", "1", None, "open", None)] * 2 + [("d", "1", "source", "it", "2", None, "close", None), ("d", "1", "source", "it", "3", None, "close", None)]}),
])
def test_version_1_rules(spark, rule, change):
    rows = {"files": [("d", "1.2", "2024-01-01T00:00:00Z", "en", "es")], "units": [("d", "1", None, None, None, "EN", None), ("d", "2", None, None, "1", None, None)], "tags": [("d", "1", "source", k, "1", None, None, None) for k in ("bx", "ex", "bpt", "ept")]} | change
    found = C.violations(C.version_1_rules(*[spark.createDataFrame(rows[t], V1[t]) for t in V1])).collect()
    assert {r.rule for r in found} == ({rule} if rule else set())


V2 = {
    "files": "doc_id string, file_id string, src_lang string, trg_lang string, skeleton_href string, skeleton_text string", "segments": "doc_id string, unit_id string, segment_id string, state string, sub_state string, source string, target string, source_lang string, target_lang string, target_order int",
    "tags": "doc_id string, unit_id string, side string, kind string, id string, start_ref string, isolated boolean, copy_of string, data_ref string, can_delete string, type string, sub_type string", "data": "doc_id string, unit_id string, id string",
}


def tag(side="source", kind="ph", id="1", start_ref=None, isolated=None, copy_of=None, data_ref=None, can_delete=None, type=None, sub_type=None):
    return ("d", "u", side, kind, id, start_ref, isolated, copy_of, data_ref, can_delete, type, sub_type)


SEG = ("d", "u", "s", "initial", None, "a", None, None, None, None)


@pytest.mark.parametrize("rule,change", [
    (None, {}), ("file_unique", {"files": [("d", "f", "en", "es", None, None)] * 2}), ("skeleton", {"files": [("d", "f", "en", "es", "h", "t")]}), ("segment_unique", {"segments": [SEG, SEG]}), ("state", {"segments": [(*SEG[:3], "odd", None, "a", "b", None, None, None)]}),
    ("state_target", {"segments": [(*SEG[:3], "translated", *SEG[4:])]}), ("sub_state", {"segments": [(*SEG[:4], "x", *SEG[5:])]}), ("target_language", {"files": [("d", "f", "en", None, None, None)], "segments": [(*SEG[:6], "b", None, None, None)]}),
    ("content_language", {"segments": [(*SEG[:7], "fr", None, None)]}), ("order_range", {"segments": [(*SEG[:9], 2)]}), ("data_unique", {"data": [("d", "u", "x")] * 2}), ("tag_unique", {"tags": [tag(), tag()]}), ("copy_or_data", {"tags": [tag(copy_of="1", data_ref="x")]}),
    ("data_ref", {"tags": [tag(data_ref="nope")]}), ("type", {"tags": [tag(type="odd")]}), ("sub_type", {"tags": [tag(sub_type="a:b")]}), ("isolated", {"tags": [tag(kind="ec", id=None, isolated=True)]}), ("closed", {"tags": [tag(kind="sc")]}),
    ("start_ref", {"tags": [tag(kind="ec", id=None, start_ref="9")]}), ("em_ref", {"tags": [tag(kind="em", id=None, start_ref="9")]}),
    ("kept", {"segments": [(*SEG[:3], "final", None, "a", "b", None, None, None)], "tags": [tag(can_delete="no")]}), ("agreement", {"segments": [(*SEG[:3], "final", None, "a", "b", None, None, None)], "tags": [tag(type="fmt"), tag("target", type="ui")]}),
])
def test_version_2_rules(spark, rule, change):
    rows = {"files": [("d", "f", "en", "es", None, None)], "segments": [SEG], "tags": [tag(data_ref="x"), tag(kind="sc", id="2"), tag(kind="ec", id="3", start_ref="2")], "data": [("d", "u", "x")]} | change
    rules = C.version_2_rules(*[spark.createDataFrame(rows[t], V2[t]) for t in V2])
    assert {r.rule for r in C.violations(rules).collect()} == ({rule} if rule else set())
    assert C.verdict(rules).first()["valid"] == (rule is None)


def test_graph(spark):
    keys = spark.createDataFrame([("", "a", None, "b", 0), ("", "b", "f1", None, 1), ("", "b", "f2", None, 2), ("s", "c", "f3", None, 3)], "scope string, key string, href string, keyref string, pos int")
    done = G.resolve_keys(keys)
    assert {(r.scope, r.key): r.href for r in done.collect()} == {("", "a"): "f1", ("", "b"): "f1", ("s", "c"): "f3"}
    uses = spark.createDataFrame([("", "s.c"), ("", "c"), ("", "zz"), ("s", "c")], "scope string, key string")
    assert {(r.scope, r.key): r.href for r in G.look_up(uses, done).collect()} == {("", "s.c"): "f3", ("", "c"): "f3", ("", "zz"): None, ("s", "c"): "f3"}
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(8)] + [("1", "0")], "from_file string, to_file string")
    got = {r.file: r.depth for r in G.discover(spark.createDataFrame([("0",)], "file string"), edges).collect()}
    assert got == {str(k): k for k in range(5)}
    elements = spark.createDataFrame([("a", "1", "old", "b", "2"), ("b", "2", "mid", "c", "3"), ("c", "3", "end", None, None)], "file string, id string, text string, ref_file string, ref_id string")
    assert {r.file: r.text for r in G.fill_references(elements).collect()} == {"a": "end", "b": "end", "c": "end"}
    values = spark.createDataFrame([("x y",), ("x z",), (None,), ("z",)], "v string")
    actions = F.create_map(F.lit("x"), F.lit("exclude"), F.lit("y"), F.lit("exclude"))
    assert [r[0] for r in values.select(G.excluded(F.col("v"), actions, F.lit(None))).collect()] == [True, False, False, False]


def test_tag_matching(spark):
    src = spark.createDataFrame([("u", 0, "1", "<b>"), ("u", 1, "2", "<b>"), ("u", 2, "3", "<i>")], "u string, pos int, id string, text string")
    tgt = spark.createDataFrame([("u", 0, "<i>"), ("u", 1, "<b>"), ("u", 2, "<b>"), ("u", 3, "<b>")], "u string, pos int, text string")
    assert {r.pos: r.id for r in R.match_tags(src, tgt, ["u"]).collect()} == {0: "3", 1: "1", 2: "2", 3: None}
    a = spark.createDataFrame([("u", "1", "keep")], "u string, mid string, text string")
    b = spark.createDataFrame([("u", "1", "changed", True), ("u", "2", "free", False)], "u string, mid string, text string, protected boolean")
    assert {r.mid: r.text for r in R.copy_protected(a, b, ["u"]).collect()} == {"1": "keep", "2": "free"}


def test_more_rules(spark):
    attrs = spark.createDataFrame([("d", "trans-unit", "id"), ("d", "trans-unit", "odd"), ("d", "trans-unit", "my:odd"), ("d", "g", "approved"), ("d", "what", "x"), ("d", "body", "xml:odd")], "doc_id string, element string, attribute string")
    assert sorted(r.place for r in C.attribute_rule(attrs).collect()) == ["d/body/xml:odd", "d/g/approved", "d/trans-unit/odd"]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    units = df([("d", "1", None, "p", None, None, None), ("d", "2", None, "zz", None, None, None)], V1["units"])
    tags = df([("d", "1", "seg-source", "mrk", None, None, None, "0"), ("d", "1", "seg-source", "mrk", None, None, None, "0"), ("d", "1", "target", "mrk", None, None, None, "5")], V1["tags"])
    more = C.version_1_parts(units, tags, df([("d", "g"), ("d", "g"), ("e", "g")], "doc_id string, group_id string"), df([("d", "p"), ("d", "p")], "doc_id string, phase string"), df([("d", "t"), ("d", "t")], "doc_id string, tool_id string"), df([("d", "1", "7", "u"), ("d", "1", "0", "t")], "doc_id string, unit_id string, mid string, tool_id string"))
    assert sorted((r.rule, r.place) for r in C.violations(more).collect()) == [("alternative", "d/1/7"), ("group_unique", "d/g"), ("mark", "d/1/5"), ("mark_unique", "d/1/0"), ("phase", "d/zz"), ("phase_unique", "d/p"), ("tool", "d/u"), ("tool_unique", "d/t")]
    modules = {"notes": df([("d", "u", "1"), ("d", "u", "1"), ("d", "v", "1")], "doc_id string, unit_id string, id string")}
    assert [r.rule for r in C.violations(C.module_rules(modules)).collect()] == ["notes_unique"]
