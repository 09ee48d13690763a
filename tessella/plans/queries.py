"""The library's operators applied to the driver's tables, and the same results in SQL.

Lines of `documents` are segments of files named by `source`; user turns of `conversations` and the answers to them are
segments with targets; `pages` are HTML files, `benchmark` a translation memory, `labels` approvals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import sources as S, srx
from ..functions import text as T
from ..operators import analysis as A, constraints as C, graph as G, relations as R, transforms as X
from ..sources import detect as D
from ..streaming import status as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return A.document_lines(A.spread_scan(docs, "doc_id")).withColumnRenamed("source", "original")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as segments: the next turn, if an assistant's, is the target; every third conversation is approved."""
    order = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("*", F.lead("role").over(order).alias("r"), F.lead("text").over(order).alias("t"))
    target = F.when(F.col("r") == "assistant", F.col("t"))
    return t.where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("original"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("unit_id"), F.lit(0).alias("seg_no"), F.lit(False).alias("is_ignorable"), (F.col("conv_id") % 7 != 0).alias("translate"), F.lit(False).alias("preserve_space"),
        (target.isNotNull() & (F.col("conv_id") % 3 == 0)).alias("approved"), F.when(target.isNotNull(), "translated").otherwise("initial").alias("state"), F.lit(None).cast("string").alias("state_qualifier"),
        F.col("text").alias("source"), target.alias("target"), F.lit("en").alias("source_lang"), F.lit("es").alias("target_lang"),
    )


_DELIMS = r"[ \t\r\n()?\x{00A0}\x{3001}\x{3002}\x{FF1A}\x{FF01}\x{FF1F}\x{4ECB}]+"


def _words(x: str) -> str:
    return (
        rf"coalesce(CAST(list_sum(list_transform(list_filter(regexp_split_to_array({x}, '{_DELIMS}'), lambda t: t <> ''), lambda t: "
        rf"CASE WHEN regexp_matches(t, '[.,\-/<>]') AND NOT regexp_matches(t, '\p{{Nd}}') THEN len(list_filter(regexp_split_to_array(t, '[.,\-/<>]+'), lambda y: y <> '')) ELSE 1 END)) AS BIGINT), 0)"
    )


_LINES = "lines AS (SELECT * FROM (SELECT doc_id, lang, source AS original, unnest(range(0, len(p))) AS pos, unnest(p) AS segment FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(segment) <> '')"
_TURNS = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS original, turn AS pos, CAST(turn AS VARCHAR) AS unit_id, conv_id % 7 <> 0 AS translate, target IS NOT NULL AND conv_id % 3 = 0 AS approved,
  CASE WHEN target IS NOT NULL THEN 'translated' ELSE 'initial' END AS state, text AS source, target FROM (
  SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""
_CLASSIFIED = """firsts AS (SELECT *, row_number() OVER w AS rn, first_value(original) OVER w AS f FROM lines WINDOW w AS (PARTITION BY segment, lang ORDER BY lower(original), original, doc_id, pos)),
classified AS (SELECT *, CASE WHEN rn = 1 THEN 'new' WHEN original = f THEN 'rep-int' ELSE 'rep-ext' END AS type FROM firsts)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.classify_repetitions(lines(spark, sf_dir).withColumn("type", F.lit("new")), ["segment", "lang"], order=("doc_id", "pos"))


@query(f"""WITH {_LINES}, {_CLASSIFIED}, counted AS (SELECT *, {_words("segment")} AS w FROM classified)
SELECT coalesce(original, 'SUM') AS original, count(*) FILTER (type = 'new') AS n_new, count(*) FILTER (type = 'rep-int') AS n_rep_int, count(*) FILTER (type = 'rep-ext') AS n_rep_ext, count(*) AS n_total,
  CAST(coalesce(sum(w) FILTER (type = 'new'), 0) AS BIGINT) AS w_new, CAST(coalesce(sum(w) FILTER (type <> 'new'), 0) AS BIGINT) AS w_repeated, CAST(sum(w) AS BIGINT) AS w_total FROM counted GROUP BY ROLLUP (original)""")
def repetition_status(spark, sf_dir):
    """The flagship: segments and words of each file by repetition class, with a total."""
    rows = A.counted(classified(spark, sf_dir), "segment", "en")
    return A.repetition_report(rows).select("original", "n_new", "n_rep_int", "n_rep_ext", "n_total", "w_new", "w_repeated", "w_total")


@query(f"WITH {_LINES} SELECT lang, CAST(sum({_words('segment')}) AS BIGINT) AS words, count(*) AS segments FROM lines GROUP BY lang")
def word_count_by_lang(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("lang").agg(F.sum(T.word_count(F.col("segment"), F.col("lang"))).alias("words"), F.count(F.lit(1)).alias("segments"))


@query(rf"""SELECT doc_id, len(regexp_replace(text, '[\x00-\xFF\x{{3001}}\x{{3002}}\x{{FF1A}}\x{{FF01}}\x{{FF1F}}\x{{4ECB}}]', '', 'g')) + {_words(r"regexp_replace(text, '[^\x00-\xFF\x{3001}\x{3002}\x{FF1A}\x{FF01}\x{FF1F}\x{4ECB}]', '', 'g')")} AS words FROM documents""")
def ideograph_count(spark, sf_dir):
    d = A.spread_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", T.count_ideographs(F.col("text")).cast("long").alias("words"))


@query(r"""SELECT source AS original, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(regexp_replace(text, '[\t\n\x0B\f\r\x1C-\x1F ]', '', 'g'))) AS BIGINT) AS spaces FROM documents GROUP BY source""")
def character_status(spark, sf_dir):
    d = A.spread_scan(table(spark, sf_dir, "documents").select("source", "text"))
    return d.groupBy(F.col("source").alias("original")).agg(F.sum(T.utf16_length(F.col("text"))).cast("long").alias("chars"), F.sum(T.space_count(F.col("text"))).cast("long").alias("spaces"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\pZ\n]+', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS digest FROM documents")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN q = 100 THEN 'exact' WHEN q BETWEEN 95 AND 99 THEN '95' WHEN q BETWEEN 85 AND 94 THEN '85' WHEN q BETWEEN 75 AND 84 THEN '75' WHEN q BETWEEN 50 AND 74 THEN '50' ELSE 'new' END AS class
FROM (SELECT greatest(n_chars % 110, CASE WHEN doc_id % 2 = 0 THEN doc_id % 90 ELSE 0 END) AS q FROM documents)) GROUP BY class""")
def match_bucket(spark, sf_dir):
    q = F.array((F.col("n_chars") % 110).cast("string"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 90).cast("string")).otherwise("98.5"))
    return table(spark, sf_dir, "documents").groupBy(T.match_class(q).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_APPROVED = f"""WITH {_LINES}, marked AS (SELECT l.*, coalesce(b.quality = 1, false) AS approved, b.doc_id IS NOT NULL AS translated, {_words('segment')} AS w, length(segment) AS c, length(segment) - length(regexp_replace(segment, '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F ]', '', 'g')) AS s FROM lines l LEFT JOIN labels b USING (doc_id))"""


@query(_APPROVED + """ SELECT original, count(*) FILTER (translated) AS segments_translated, count(*) FILTER (NOT translated) AS segments_not_translated, count(*) FILTER (approved) AS segments_approved, count(*) FILTER (NOT approved) AS segments_not_approved,
CAST(coalesce(sum(w) FILTER (approved), 0) AS BIGINT) AS words_approved, CAST(coalesce(sum(w) FILTER (NOT approved), 0) AS BIGINT) AS words_not_approved, CAST(coalesce(sum(c - s) FILTER (approved), 0) AS BIGINT) AS chars_approved FROM marked GROUP BY original""")
def status_by_label(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("approved"), F.lit(True).alias("translated"))
    rows = lines(spark, sf_dir).join(labels, "doc_id", "left").fillna(False, ["approved", "translated"])
    report = A.status_report(A.counted(rows, "segment", "en"), total=None)
    return report.select("original", "segments_translated", "segments_not_translated", "segments_approved", "segments_not_approved", "words_approved", "words_not_approved", "chars_approved")


@query(f"""WITH {_LINES}, firsts AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY doc_id, pos) AS rn, {_words('segment')} AS w FROM lines)
SELECT CAST(sum(w) FILTER (rn = 1) AS BIGINT) AS w_new, CAST(coalesce(sum(w) FILTER (rn > 1), 0) AS BIGINT) AS w_repeated, CAST(sum(w) AS BIGINT) AS w_all FROM firsts""")
def whole_analysis(spark, sf_dir):
    rows = lines(spark, sf_dir).select("segment", "doc_id", "pos", F.lit(True).alias("translate"), F.lit("new").alias("type"), T.word_count(F.col("segment"), "en").cast("long").alias("words"), F.lit(False).alias("approved"), F.lit(False).alias("translated"))
    return A.whole_analysis(rows, ["segment"], ["doc_id", "pos"]).select("w_new", "w_repeated", "w_all")


@query(f"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY original ORDER BY doc_id, pos) - 1 AS k, count(*) OVER (PARTITION BY original) AS c FROM lines),
b AS (SELECT original, CAST(floor(k / (CASE WHEN c <= 200 THEN 1 ELSE ceil(c / 200.0) END)) AS INTEGER) AS bucket, length(segment) % 101 AS q, length(segment) % 2 = 0 AS t FROM n)
SELECT original, bucket, avg(q) AS quality, CAST(CASE WHEN sum(t::INT) > floor(count(*) / 2) OR count(*) = 1 AND sum(t::INT) = 1 THEN 100 ELSE 0 END AS INTEGER) AS translated FROM b GROUP BY original, bucket""")
def chart_buckets(spark, sf_dir):
    rows = lines(spark, sf_dir).select("original", F.struct("doc_id", "pos").alias("at"), (F.length("segment") % 101).alias("quality"), (F.length("segment") % 2 == 0).alias("translated"), F.lit(False).alias("approved"))
    return A.chart_buckets(rows, "original", "at").drop("approved")


_CONTEXT = """ctx AS (SELECT *, lag(segment) OVER w AS pv, lead(segment) OVER w AS nx FROM lines WINDOW w AS (PARTITION BY original ORDER BY doc_id, pos))"""


@query(f"""WITH {_LINES}, {_CONTEXT}, old AS (SELECT ctx.* FROM ctx JOIN labels USING (doc_id) WHERE quality = 1), hits AS (
SELECT n.original, n.doc_id, n.pos, max(struct_pack(a := o.doc_id, b := o.pos)) AS best FROM ctx n JOIN old o ON n.original = o.original AND n.segment = o.segment AND (n.pv IS NULL OR n.pv = o.pv) AND (n.nx IS NULL OR n.nx = o.nx) GROUP BY ALL)
SELECT original, doc_id, pos, best.a AS old_doc FROM hits""")
def ice_matches(spark, sf_dir):
    """New version: all lines, old version: the same, those of good documents approved; targets say where they come from."""
    good = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    rows = lines(spark, sf_dir).select("original", "doc_id", F.struct("doc_id", "pos").alias("at"), F.col("segment").alias("source"), F.lit(None).cast("string").alias("state_qualifier"))
    old = rows.join(good, "doc_id", "left").withColumns({"approved": F.coalesce("good", F.lit(False)), "target": F.col("doc_id").cast("string")})
    new = rows.withColumns({"translate": F.lit(True), "approved": F.lit(False), "target": F.lit(None).cast("string")})
    found = R.in_context_matches(old, new, pos="at")
    return found.where("approved").select("original", "doc_id", F.col("at.pos").alias("pos"), F.col("target").cast("long").alias("old_doc"))


@query(f"""WITH {_TURNS}, b AS (SELECT original, pos, CASE WHEN pos % 4 = 0 THEN source || '!' ELSE source END AS source FROM turns WHERE NOT (CAST(original AS BIGINT) % 5 = 0 AND pos > 0))
SELECT coalesce(a.original, b.original) AS original, coalesce(a.pos, b.pos) AS pos, CASE WHEN b.pos IS NULL THEN 'only_a' WHEN a.pos IS NULL THEN 'only_b' ELSE 'changed' END AS kind
FROM turns a FULL JOIN b ON a.original = b.original AND a.pos = b.pos WHERE a.source IS DISTINCT FROM b.source""")
def compare_positional(spark, sf_dir):
    a = turns(spark, sf_dir).select("original", "pos", "source")
    b = a.where(~((F.col("original").cast("long") % 5 == 0) & (F.col("pos") > 0))).withColumn("source", F.when(F.col("pos") % 4 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    return R.compare(a, b, ["original", "pos"], ["source"])


_SHOWN = ["original", "pos", "target", "state", "approved"]


@query(f"WITH {_TURNS} SELECT original, pos, target, CASE WHEN h THEN 'final' ELSE state END AS state, h OR approved AS approved FROM (SELECT *, translate AND length(coalesce(target, '')) > 0 AS h FROM turns)")
def approve_all(spark, sf_dir):
    return X.approve_all(turns(spark, sf_dir)).select(_SHOWN)


@query(f"WITH {_TURNS} SELECT original, pos, CASE WHEN h THEN source ELSE target END AS target, CASE WHEN h THEN 'translated' ELSE state END AS state, approved FROM (SELECT *, translate AND target IS NULL AS h FROM turns)")
def copy_sources(spark, sf_dir):
    return X.copy_sources(turns(spark, sf_dir)).select(_SHOWN)


@query(f"WITH {_TURNS} SELECT original, pos, CASE WHEN h THEN translate(source, 'aeiouAEIOU', 'áèîöúÁÈÎÖÚ') ELSE target END AS target, CASE WHEN h THEN 'translated' ELSE state END AS state, approved FROM (SELECT *, translate AND NOT approved AND coalesce(target, '') = '' AS h FROM turns)".replace(" translate AND NOT", ' "translate" AND NOT'))
def pseudo_translate(spark, sf_dir):
    return X.pseudo_translate(turns(spark, sf_dir)).select(_SHOWN)


@query(f"WITH {_TURNS} SELECT original, pos, true AS cleared, 'initial' AS state, true AS open FROM turns")
def remove_targets(spark, sf_dir):
    return X.remove_targets(turns(spark, sf_dir)).select("original", "pos", F.col("target").isNull().alias("cleared"), "state", F.col("approved").isNull().alias("open"))


@query(f"WITH {_TURNS} SELECT original, pos, CASE WHEN approved THEN 'final' WHEN length(coalesce(target, '')) > 0 THEN 'translated' ELSE 'initial' END AS state, CASE WHEN pos % 4 = 0 THEN 'locked:yes' END AS sub_state FROM turns")
def to_version_2(spark, sf_dir):
    return X.to_version_2(turns(spark, sf_dir).withColumn("ts", F.when(F.col("pos") % 4 == 0, "locked"))).select("original", "pos", "state", "sub_state")


@query("SELECT l_orderkey AS unit, string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS source, bool_or(l_linestatus = 'F') AS approved FROM lineitem GROUP BY l_orderkey")
def to_version_1(spark, sf_dir):
    """Order lines as the segments of a unit: texts end to end, approved if any is final."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("seg_no"), F.col("l_partkey").cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("is_ignorable"), F.when(F.col("l_linestatus") == "F", "final").otherwise("initial").alias("state"))
    return X.to_version_1(s, ["unit"]).select("unit", "source", "approved")


@query("SELECT l_orderkey AS grp, string_agg(CAST(l_suppkey AS VARCHAR), '' ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS source, bool_and(l_linestatus = 'F') AS approved FROM lineitem GROUP BY l_orderkey")
def join_split_groups(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").cast("string").alias("source"), F.lit("").alias("target"), (F.col("l_linestatus") == "F").alias("approved"))
    return X.join_split_groups(s, ["grp"]).select("grp", "source", "approved")


_JHASH = "CAST((list_reduce([0::BIGINT] || list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296) + 2147483648) % 4294967296 - 2147483648 AS INTEGER)"


@query(f"SELECT page_id, {_JHASH.format('url')} AS h FROM pages")
def url_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.java_hash(F.col("url")).alias("h"))


@query(f"WITH {_TURNS} SELECT CAST({_JHASH.format('original')} AS VARCHAR) || '-0-' || CAST({_JHASH.format('unit_id')} AS VARCHAR) AS tuid, trim(source) AS seg_src, trim(target) AS seg_tgt FROM turns WHERE approved AND length(source) > 0 AND target IS NOT NULL")
def tmx_rows(spark, sf_dir):
    return X.tmx_units(turns(spark, sf_dir), F.lit(0)).select("tuid", "seg_src", "seg_tgt")


@query(f"""WITH {_TURNS}, u AS (SELECT 0 AS n, 'x/a/' || original AS o, pos FROM turns WHERE CAST(original AS BIGINT) % 2 = 0 UNION ALL SELECT 1, 'x/b/' || original, pos FROM turns WHERE CAST(original AS BIGINT) % 2 = 1),
f AS (SELECT n, o, CAST(row_number() OVER (ORDER BY n, CAST(substr(o, 5) AS BIGINT)) - 1 AS INTEGER) AS file_no FROM (SELECT DISTINCT n, o FROM u)) SELECT file_no, substr(u.o, 3) AS original, pos FROM u JOIN f ON u.o = f.o""")
def join_union(spark, sf_dir):
    rows = turns(spark, sf_dir).select(F.col("original").cast("long").alias("file_no"), "original", "pos").withColumns({"version": F.lit("1.2"), "src_lang": F.lit("en"), "tgt_lang": F.lit("es")})
    even = rows.where("file_no % 2 = 0").withColumn("original", F.concat(F.lit("x/a/"), "original"))
    odd = rows.where("file_no % 2 = 1").withColumn("original", F.concat(F.lit("x/b/"), "original"))
    return R.join_files([even, odd]).select("file_no", "original", "pos")


@query("""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, string_split(regexp_replace(url, '[/\\\\:]', '/', 'g'), '/') AS s FROM pages),
m AS (SELECT host, min(s) AS a, max(s) AS b FROM p GROUP BY host), n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS k FROM m)
SELECT host, CASE WHEN k = len(a) THEN array_to_string(a[1:k - 1], '/') ELSE array_to_string(a[1:k], '/') END AS root FROM n""")
def tree_root(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "url")
    return pages.groupBy("host").agg(R.tree_root(F.collect_set("url")).alias("root"))


@query("SELECT 'page' AS kind, page_id AS id, CASE WHEN starts_with(html, '<!DOCTYPE') AND contains(substr(html, 1, 40960), ' html') THEN 'HTML' WHEN contains(lower(substr(html, 1, 40960)), '<html') THEN 'HTML' END AS format FROM pages UNION ALL SELECT 'event', event_id, CASE WHEN regexp_matches(props, '^\\s*[{\\[]') THEN 'JSON' END FROM events")
def detect_format(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), D.detect_text(F.col("html")).alias("format"))
    return pages.unionByName(table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), D.detect_text(F.col("props")).alias("format")))


@query(f"""WITH {_TURNS} SELECT original, string_agg('[' || CAST(pos AS VARCHAR) || ']' || CASE WHEN approved AND target IS NOT NULL THEN target ELSE source END, '' ORDER BY pos) AS text FROM turns GROUP BY original""")
def merge_skeleton(spark, sf_dir):
    """Each conversation's skeleton has a literal and a place for every segment."""
    seg = turns(spark, sf_dir)
    parts = seg.select(F.col("original").alias("doc_id"), F.explode(F.array(F.struct((F.col("pos") * 2).alias("part_no"), F.lit("literal").alias("kind"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("literal"), F.lit(None).cast("string").alias("ref_id")), F.struct((F.col("pos") * 2 + 1).alias("part_no"), F.lit("ref").alias("kind"), F.lit(None).cast("string").alias("literal"), F.col("unit_id").alias("ref_id")))).alias("p")).select("doc_id", "p.*")
    return R.merge_documents(parts, seg.withColumnRenamed("original", "doc_id")).withColumnRenamed("doc_id", "original")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<[A-Za-z/][^>]*>')) AS tags, length(regexp_replace(html, '<[A-Za-z/][^>]*>', '', 'g')) AS text_chars FROM pages")
def tag_split(spark, sf_dir):
    pieces = T.split_tags(F.col("html"))
    is_tag = lambda x: x.rlike("^<[A-Za-z/][^>]*>$")
    p = table(spark, sf_dir, "pages").select("page_id", pieces.alias("p"))
    return p.select("page_id", F.size(F.filter("p", is_tag)).cast("long").alias("tags"), F.length(F.array_join(F.filter("p", lambda x: ~is_tag(x)), "")).cast("long").alias("text_chars"))


@query(r"SELECT page_id, md5(regexp_replace(html, '[ \n\t\r\f]+', ' ', 'g')) AS digest FROM pages")
def collapse_space(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.collapse_space(F.col("html"))).alias("digest"))


@query(r"SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)")
def json_leaves(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("props is not null").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.select("event_id", "value", "key")


@query(r"SELECT event_id, regexp_matches(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$') AS valid, strftime(ts, '%Y%m%dT%H%M%SZ') AS compact, 'new=' || CAST(user_id AS VARCHAR) || ';ice=' || CAST(event_id AS VARCHAR) || ';' AS status, CAST(user_id AS INTEGER) AS parsed FROM events")
def dates_and_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("d"), "ts", F.col("user_id").alias("new"), F.col("event_id").alias("ice"))
    status = T.format_status("new", "ice")
    return e.select("event_id", T.is_date(F.col("d")).alias("valid"), T.tmx_date(F.col("ts")).alias("compact"), status.alias("status"), T.parse_status(status)["new"].alias("parsed"))


@query(r"SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z_][-.0-9A-Za-z_]*$') AS ncname, regexp_matches(CAST(p_size AS VARCHAR), '^[0-9][0-9.,]*$') AS number FROM part")
def name_predicates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.is_ncname(F.col("p_name")).alias("ncname"), T.is_number_cell(F.col("p_size").cast("string")).alias("number"))


@query("SELECT conv_id, count(*) AS units, max(turn) AS last FROM conversations GROUP BY conv_id")
def count_segments(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("units"), F.max("turn").alias("last"))


@query("""SELECT 'lineitem_unique' AS rule, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS place, 'not unique' AS reason FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'order_customer', CAST(o_custkey AS VARCHAR), 'refers to nothing' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'low_stock', CAST(l_orderkey AS VARCHAR), 'quantity' FROM lineitem WHERE l_quantity > 49
UNION ALL SELECT DISTINCT 'source_unlabelled', CAST(doc_id AS VARCHAR), 'refers to nothing' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def constraints(spark, sf_dir):
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return C.violations({
        "a": C.unique(lineitem, ["l_orderkey", "l_linenumber"], "lineitem_unique"),
        "b": C.refers(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "order_customer"),
        "c": C.check(lineitem, F.col("l_quantity") > 49, "l_orderkey", "low_stock", "quantity"),
        "d": C.refers(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id", "source_unlabelled"),
    })


@query("""WITH k AS (SELECT CAST(n_regionkey AS VARCHAR) AS scope, substr(n_name, 1, 1) AS key, n_name AS href, n_nationkey AS pos FROM nation)
SELECT scope, key, href FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY pos) AS n FROM k) WHERE n = 1""")
def key_scopes(spark, sf_dir):
    k = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("scope"), F.substring("n_name", 1, 1).alias("key"), F.col("n_name").alias("href"), F.lit(None).cast("string").alias("keyref"), F.col("n_nationkey").alias("pos"))
    return G.resolve_keys(k)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation),
r AS (SELECT 0 AS file, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON r.file = e.a WHERE r.depth < 4) SELECT file, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY file""")
def topic_discovery(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    edges = n.select(F.col("n_nationkey").alias("from_file"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("to_file")).unionByName(n.select(F.col("n_nationkey").alias("from_file"), ((F.col("n_nationkey") + 7) % 25).alias("to_file")))
    return G.discover(n.where("n_nationkey = 0").select(F.col("n_nationkey").alias("file")), edges)


@query("""SELECT p_partkey, len(v) > 0 AND len(list_filter(v, lambda x: x NOT IN ('ECONOMY', 'TIN', 'ANODIZED'))) = 0 AS dropped FROM (SELECT p_partkey, list_filter(regexp_split_to_array(coalesce(p_type, ''), '\\s+'), lambda x: x <> '') AS v FROM part)""")
def conditional_filter(spark, sf_dir):
    actions = F.create_map(*[F.lit(x) for v in ("ECONOMY", "TIN", "ANODIZED") for x in (v, "exclude")])
    return table(spark, sf_dir, "part").select("p_partkey", G.excluded(F.col("p_type"), actions, F.lit("include")).alias("dropped"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS day_us, count(*) AS n FROM events GROUP BY ALL")
def status_history(spark, sf_dir):
    return ST.history(table(spark, sf_dir, "events"), "1 day").select("event_type", F.unix_micros(F.col("start").cast("timestamp")).alias("day_us"), "n")


@query()
def sentence_segments(spark, sf_dir):
    """Sentences of all documents by their languages' rules."""
    d = A.spread_scan(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return d.select("doc_id", F.posexplode(srx.segment(F.col("text"), F.col("lang"))).alias("pos", "segment"))


@query()
def html_segments(spark, sf_dir):
    pages = A.spread_scan(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return S.segments_of(S.parts_of(pages, "HTML", "utf-8", "page_id", "html")).select("doc_id", "pos", "unit_id", "source")


@query(r"SELECT CAST(page_id AS VARCHAR) AS doc_id, md5(regexp_replace(html, '[ \t\n\x0B\f\r]+', '', 'g')) AS digest FROM pages")
def html_round_trip(spark, sf_dir):
    """Pages put together again from their parts, with unchanged sources: they are the same but for white space."""
    pages = A.spread_scan(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    parts = S.parts_of(pages, "HTML", "utf-8", "page_id", "html")
    again = S.merge_text(parts, S.segments_of(parts))
    return again.select("doc_id", F.md5(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", "")).alias("digest"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, segment AS source FROM lines")
def plain_text_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", F.col("segment").alias("source"))


@query()
def resegmented(spark, sf_dir):
    u = turns(spark, sf_dir).withColumns({"matches": F.array().cast("array<string>"), "target": F.lit(None).cast("string"), "src_lang": F.col("source_lang")}).drop("seg_no", "is_ignorable")
    return srx.resegment(u).select("original", "unit_id", "seg_no", "segment_id", "source")
