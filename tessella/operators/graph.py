"""Maps of topics: key scopes, topic discovery, content references and conditional filters, as bounded iterations of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROUNDS = 4


def first_definitions(keys: DataFrame) -> DataFrame:
    """Of the definitions (scope, key, pos, ...) of each scope and key, the first."""
    order = W.partitionBy("scope", "key").orderBy("pos")
    return keys.select("*", F.row_number().over(order).alias("_n")).where("_n = 1").drop("_n")


def resolve_keys(keys: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(scope, key, href): each key's file, following keyref chains within the scope, up to `rounds` steps."""
    known = first_definitions(keys).select("scope", "key", "href", "keyref")
    now = known
    step = known.select(F.col("scope").alias("_s"), F.col("key").alias("_k"), F.col("href").alias("_h"), F.col("keyref").alias("_r"))
    for _ in range(rounds):
        now = now.join(step, (F.col("scope") == F.col("_s")) & (F.col("keyref") == F.col("_k")) & F.col("href").isNull(), "left")
        now = now.select("scope", "key", F.coalesce("href", "_h").alias("href"), F.when(F.col("href").isNull(), F.col("_r")).alias("keyref"))
    return now.select("scope", "key", "href")


def look_up(uses: DataFrame, resolved: DataFrame) -> DataFrame:
    """uses (scope, key, ...) with href: of the same scope, or of the scope that a dotted key names, else of the nearest scope below."""
    dotted = F.col("key").contains(".")
    path = F.when(dotted, F.concat_ws(".", F.when(F.col("scope") != "", F.col("scope")), F.regexp_extract("key", r"^(.*)\.[^.]*$", 1))).otherwise(F.col("scope"))
    name = F.when(dotted, F.regexp_extract("key", r"([^.]*)$", 1)).otherwise(F.col("key"))
    asked = uses.withColumns({"_path": path, "_name": name, "_use": F.xxhash64("scope", "key")})
    r = resolved.select(F.col("scope").alias("_s"), F.col("key").alias("_k"), F.col("href").alias("_h"))
    below = (F.col("_s") == F.col("_path")) | F.when(F.col("_path") == "", F.lit(True)).otherwise(F.col("_s").startswith(F.concat("_path", F.lit("."))))
    hits = asked.select("scope", "key", "_path", "_name").distinct().join(r, (F.col("_name") == F.col("_k")) & below)
    best = hits.groupBy("scope", "key").agg(F.min_by("_h", F.struct(F.size(F.split("_s", r"\.")), F.col("_s") != F.col("_path"), "_s")).alias("href"))
    return uses.join(best, ["scope", "key"], "left")


def discover(roots: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(file, depth): files reached from roots (file) over edges (from_file, to_file), in `rounds` steps at most."""
    seen = roots.select("file").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, rounds + 1):
        found = front.join(edges, front.file == edges.from_file).select(F.col("to_file").alias("file")).distinct()
        front = found.join(seen.select("file"), "file", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen


def excluded(attribute: Column, actions: Column, default: Column) -> Column:
    """Whether a filter drops an element by one attribute: all its values are excluded, by themselves or by default.

    actions: map of value to include or exclude; default: the action for other values of the attribute.
    """
    values = F.filter(F.split(F.coalesce(attribute, F.lit("")), "\\s+"), lambda v: v != "")
    return (F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(F.element_at(actions, v), default, F.lit("include")) == "exclude")


def fill_references(elements: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """elements (file, id, text, ref_file, ref_id) with the text of what they refer to, through chains of `rounds` steps."""
    source = elements.select(F.col("file").alias("_f"), F.col("id").alias("_i"), F.col("text").alias("_t"), F.col("ref_file").alias("_rf"), F.col("ref_id").alias("_ri")).dropDuplicates(["_f", "_i"])
    now = elements
    for _ in range(rounds):
        hit = F.col("_f").isNotNull()
        now = now.join(source, (F.col("ref_file") == F.col("_f")) & (F.col("ref_id") == F.col("_i")), "left").withColumns(
            {"text": F.when(hit, F.col("_t")).otherwise(F.col("text")), "ref_file": F.col("_rf"), "ref_id": F.col("_ri")}
        ).drop("_f", "_i", "_t", "_rf", "_ri")
    return now.select("file", "id", "text")
