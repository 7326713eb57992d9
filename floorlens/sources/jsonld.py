"""Knowledge graphs as JSON-LD: reading documents into node and edge tables, assembling them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import polygons

PREDICATES = ["containsZone", "containsElement", "adjacentZone", "interfaceOf", "hasSpace"]
_NODE = "map<string,string>"


def string_or_list(json: Column) -> Column:
    """A JSON string or list of strings as array<string>."""
    wrapped = F.concat(F.lit('{"t":'), F.coalesce(json, F.lit("null")), F.lit("}"))
    many = F.from_json(wrapped, "t array<string>")["t"]
    return F.coalesce(many, F.when(json.isNotNull(), F.array(F.trim(json, F.lit('"')))), F.array().cast("array<string>"))


def references(json: Column) -> Column:
    """Ids of a list of references, one reference or a bare string."""
    wrapped = F.concat(F.lit('{"t":'), F.coalesce(json, F.lit("null")), F.lit("}"))
    many = F.from_json(wrapped, "t array<struct<`@id`:string>>")["t"]
    one = F.from_json(wrapped, "t struct<`@id`:string>")["t"]
    bare = F.get_json_object(wrapped, "$.t")
    none = F.array().cast("array<string>")
    listed = F.when(F.size(F.coalesce(many, F.array().cast("array<struct<`@id`:string>>"))) > 0, F.transform(many, lambda r: r["@id"]))
    return F.coalesce(F.filter(listed, lambda r: r.isNotNull()), F.when(one["@id"].isNotNull(), F.array(one["@id"])), F.when(bare.isNotNull() & ~bare.startswith("[") & ~bare.startswith("{"), F.array(bare)), none)


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all documents under the path; drawing is the file's base name.

    Nodes: drawing, node_id, ord, types, wkt, polygon (parts with holes), ring (the largest part's outer one), attrs. Edges: drawing, src, pred, dst, ord.
    """
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json(ld)?$", "")
    raw = spark.read.text(path, wholetext=True).select(name.alias("drawing"), "value")
    graph = F.from_json(F.get_json_object("value", "$['@graph']"), f"array<{_NODE}>")
    each = raw.select("drawing", F.posexplode(graph).alias("ord", "attrs"))
    key = lambda k: F.try_element_at("attrs", F.lit(k))
    wkt = key("geo:asWKT")
    wkt = F.coalesce(F.get_json_object(wkt, "$['@value']"), wkt)
    nodes = each.select("drawing", key("@id").alias("node_id"), "ord", string_or_list(F.when(key("@type").startswith("["), key("@type")).otherwise(F.concat(F.lit('"'), key("@type"), F.lit('"')))).alias("types"), wkt.alias("wkt"), "attrs")
    nodes = nodes.withColumn("polygon", polygons.from_wkt(F.col("wkt"))).withColumn("ring", polygons.largest(F.col("polygon"))["outer"])
    links = F.array(*(F.struct(F.lit(p).alias("pred"), references(F.coalesce(key(f"bot:{p}"), F.lit("null"))).alias("to")) for p in PREDICATES))
    edges = each.select("drawing", key("@id").alias("src"), F.explode(links).alias("l")).select("drawing", "src", "l.pred", F.posexplode("l.to").alias("ord", "dst"))
    return nodes.select("drawing", "node_id", "ord", "types", "wkt", "ring", "polygon", "attrs"), edges


def node_kinds(nodes: DataFrame) -> DataFrame:
    """drawing, node_id, kind (space, door or facility), shown (its first type of that kind), ring.

    Nodes without a ring, or of none of these kinds, are left out.
    """
    of = lambda prefix: F.filter("types", lambda t: t.startswith(prefix))
    things = of("beo:")
    is_space, is_door = F.array_contains("types", "bot:Space"), F.exists(things, lambda t: t.contains("Door"))
    kind = F.when(is_space, "space").when(is_door, "door").when(F.size(things) > 0, "facility")
    shown = F.coalesce(F.try_element_at(F.when(is_space, of("bldg:")).otherwise(things), F.lit(1)), F.lit("Unknown"))
    return nodes.where(F.col("ring").isNotNull() & kind.isNotNull()).select("drawing", "node_id", kind.alias("kind"), shown.alias("shown"), "ring")


def read_plain_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rooms, adjacencies and violations of documents {"rooms": {id: {...}}, "adjacencies": [[a, b]], "violations": [...]}.

    Rooms: drawing, room_id, wkt, ring, polygon, area_m2, short_side_m, semantic_type. Adjacencies: drawing, u, v
    in order, once. Violations: drawing, node_id, rule.
    """
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json(ld)?$", "")
    raw = spark.read.text(path, wholetext=True).select(name.alias("drawing"), "value")
    room = "struct<wkt:string,area:double,short_side:double,semantic_type:string>"
    doc = F.from_json("value", f"rooms map<string,{room}>, adjacencies array<array<string>>, violations array<struct<node_id:string,rule:string>>")
    doc = raw.select("drawing", doc.alias("d"))
    rooms = doc.select("drawing", F.explode("d.rooms").alias("room_id", "r"))
    polygon = polygons.from_wkt(F.col("r.wkt"))
    rooms = rooms.select("drawing", "room_id", "r.wkt", polygons.largest(polygon)["outer"].alias("ring"), polygon.alias("polygon"), F.col("r.area").alias("area_m2"), F.col("r.short_side").alias("short_side_m"), "r.semantic_type")
    pairs = doc.select("drawing", F.explode("d.adjacencies").alias("p")).where(F.size("p") == 2).select("drawing", F.array_min("p").alias("u"), F.array_max("p").alias("v"))
    return rooms, pairs.where("u <> v").distinct(), doc.select("drawing", F.explode("d.violations").alias("v")).select("drawing", "v.node_id", "v.rule")


def node_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """drawing_id, node_id, ord, json of nodes (drawing_id, node_id, ord, types, label, and ring or polygon) with their edges."""
    refs = edges.groupBy("drawing_id", F.col("src").alias("node_id"), "pred").agg(F.sort_array(F.collect_set("dst")).alias("to"))
    refs = refs.groupBy("drawing_id", "node_id").pivot("pred", PREDICATES).agg(F.first("to"))
    held = nodes.join(refs, ["drawing_id", "node_id"], "left")
    links = [F.transform(F.col(p), lambda r: F.struct(r.alias("@id"))).alias(f"bot:{p}") for p in PREDICATES]
    shape = polygons.to_wkt(F.col("polygon")) if "polygon" in nodes.columns else G.to_wkt(F.col("ring"))
    body = F.to_json(F.struct(F.col("node_id").alias("@id"), F.col("types").alias("@type"), F.col("label").alias("rdfs:label"), shape.alias("geo:asWKT"), *links))
    return held.select("drawing_id", "node_id", "ord", body.alias("json"))


def graph_json(bodies: DataFrame) -> DataFrame:
    """drawing_id, json: one document per drawing. A drawing's nodes are few hundred."""
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("ord", "node_id", "json"))), lambda n: n["json"])
    context = '{"@context":{"bot":"https://w3id.org/bot#","geo":"http://www.opengis.net/ont/geosparql#"},"@graph":['
    return bodies.groupBy("drawing_id").agg(F.concat(F.lit(context), F.array_join(nodes, ","), F.lit("]}")).alias("json"))


def write_graphs(documents: DataFrame, path: str) -> None:
    """One folder per drawing, UTF-8, one document a file."""
    documents.select("drawing_id", F.col("json").alias("value")).repartition("drawing_id").write.partitionBy("drawing_id").option("maxRecordsPerFile", 1).text(path)


def write_table_csv(table: DataFrame, path: str) -> None:
    """CSV files with a header, each begun by a byte-order mark, by which spreadsheets know UTF-8."""
    first = table.columns[0]
    table.withColumnRenamed(first, "\ufeff" + first).write.option("header", True).csv(path)
