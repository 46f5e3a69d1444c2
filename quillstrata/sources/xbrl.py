"""XBRL instances with their linkbases: facts with periods, units, dimensions, labels and places in presentation trees.

Python only turns a file into one row a node; contexts, units, labels and trees are joins and aggregates of such rows, so
that any number of filings is read in one job. Nothing is fetched: what the given files don't define stays null.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.operators.trees import effective_edges, walk_trees

# Namespaces and roles of the standard.
INSTANCE = "http://www.xbrl.org/2003/instance"
LINKS = "http://www.xbrl.org/2003/linkbase"
XLINK = "http://www.w3.org/1999/xlink"
DIMENSIONS = "http://xbrl.org/2006/xbrldi"
SCHEMA = "http://www.w3.org/2001/XMLSchema"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
XML = "http://www.w3.org/XML/1998/namespace"
STANDARD_LABEL = "http://www.xbrl.org/2003/role/label"

NODES = "path string, node long, parent long, top long, depth int, prefix string, space string, name string, parent_name string, attributes map<string,string>, text string"


def _nodes(content: bytes) -> Iterator[tuple]:
    """(node, parent, top, depth, prefix, space, name, parent's name, attributes, text) of every element; what was read is let go."""
    scopes: list[tuple[str, str]] = []
    opened: list[tuple[int, str, int]] = []
    root = None
    n = 0
    for event, x in ET.iterparse(io.BytesIO(content), ("start", "end", "start-ns", "end-ns")):
        if event == "start-ns":
            scopes.append((x[1], x[0]))
        elif event == "end-ns":
            scopes.pop()
        elif event == "start":
            root = x if root is None else root
            opened.append((n, x.tag, len(opened)))
            n += 1
        else:
            node, tag, depth = opened.pop()
            space, _, name = tag.rpartition("}")
            space = space[1:]
            # Tails belong to the element itself; its children were emptied when they ended.
            text = "".join([x.text or "", *(c.tail or "" for c in x)]).strip()
            prefix = next((p for s, p in reversed(scopes) if s == space), None)
            top = opened[1][0] if len(opened) > 1 else node if opened else None
            yield node, opened[-1][0] if opened else None, top, depth, prefix, space, name, opened[-1][1].rpartition("}")[2] if opened else None, list(x.attrib.items()), text
            x.clear()
            if depth == 1:
                root.remove(x)


def read_nodes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of NODES: one row an element of each file; attributes of a namespace are called {namespace}name.

    top: the node below the root that holds an element. A file that is no XML fails the query with its path.
    """
    schema = pa.schema([("path", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("top", pa.int64()), ("depth", pa.int32()), *((c, pa.string()) for c in ("prefix", "space", "name", "parent_name")), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows: list[tuple] = []
                try:
                    for row in _nodes(content.as_py()):
                        rows.append((file, *row))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                except ET.ParseError as error:
                    raise ValueError(f"{file}: {error}") from None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, NODES)


def _attribute(name: str, space: str | None = None) -> Column:
    return F.try_element_at("attributes", F.lit(f"{{{space}}}{name}" if space else name))


def _is(space: str, *names: str) -> Column:
    return (F.col("space") == space) & F.col("name").isin(*names)


def contexts(nodes: DataFrame) -> DataFrame:
    """path, context, entity, scheme, instant, start, end (dates), dimensions (array of axis, member; sorted)."""
    # What a context says meets in one aggregate, which begins where the nodes are; values of typed members are among its nodes.
    one = lambda when, value: F.max(F.when(when, value))
    text = F.col("text")
    is_member, is_typed = _is(DIMENSIONS, "explicitMember", "typedMember"), F.coalesce(F.col("parent_name") == "typedMember", F.lit(False))
    members = F.collect_list(F.when(is_member, F.struct("node", _attribute("dimension").alias("axis"), "text")))
    typed = F.collect_list(F.when(is_typed, F.struct(F.col("parent").alias("node"), "text")))
    inside = nodes.where(F.col("top").isNotNull() & (_is(INSTANCE, "context", "identifier", "instant", "startDate", "endDate") | is_member | is_typed))
    said = inside.groupBy("path", "top").agg(
        one(_is(INSTANCE, "context") & (F.col("depth") == 1), _attribute("id")).alias("context"), one(_is(INSTANCE, "identifier"), text).alias("entity"), one(_is(INSTANCE, "identifier"), _attribute("scheme")).alias("scheme"),
        *(one(_is(INSTANCE, tag), F.left(text, F.lit(10))).try_cast("date").alias(name) for tag, name in (("instant", "instant"), ("startDate", "start"), ("endDate", "end"))), members.alias("__qs_members"), typed.alias("__qs_typed"),
    )
    value = lambda m: F.array_min(F.transform(F.filter("__qs_typed", lambda t: t["node"] == m["node"]), lambda t: t["text"]))
    pairs = F.transform("__qs_members", lambda m: F.struct(m["axis"].alias("axis"), F.coalesce(value(m), m["text"]).alias("member")))
    made = said.withColumn("dimensions", F.sort_array(pairs)).drop("__qs_members", "__qs_typed")
    return made.where("context IS NOT NULL").drop("top")


def units(nodes: DataFrame) -> DataFrame:
    """path, unit, measure: measures joined by *, divided ones after /."""
    part = lambda test: F.array_join(F.sort_array(F.collect_list(F.when(_is(INSTANCE, "measure") & test, F.col("text")))), "*")
    under = F.col("parent_name") == "unitDenominator"
    made = nodes.where(F.col("top").isNotNull() & _is(INSTANCE, "unit", "measure")).groupBy("path", "top").agg(F.max(F.when(_is(INSTANCE, "unit") & (F.col("depth") == 1), _attribute("id"))).alias("unit"), part(~under).alias("over"), part(under).alias("below"))
    return made.where("unit IS NOT NULL").select("path", "unit", F.when(F.col("below") == "", F.col("over")).otherwise(F.concat_ws("/", "over", "below")).alias("measure"))


def concept_ids(nodes: DataFrame) -> DataFrame:
    """space, name, concept: ids that schema files give to elements."""
    spaces = nodes.where(_is(SCHEMA, "schema")).select("path", _attribute("targetNamespace").alias("of"))
    named = nodes.where(_is(SCHEMA, "element")).select("path", _attribute("name").alias("name"), _attribute("id").alias("concept")).where("name IS NOT NULL AND concept IS NOT NULL")
    return named.join(spaces, "path").groupBy(F.col("of").alias("space"), "name").agg(F.min("concept").alias("concept"))


def facts(nodes: DataFrame) -> DataFrame:
    """path, node, concept, kind, value, decimals, nil, and the context's and unit's fields; one row a fact.

    kind: numeric (it has a unit), text block (its value holds mark-up or its name says so) or text. A context or unit that
    the file doesn't define leaves null fields. concept: the schema's id, or prefix_name where no given file declares it.
    """
    found = nodes.where(F.map_contains_key("attributes", "contextRef")).select("path", "node", "prefix", "space", "name", _attribute("contextRef").alias("context"), _attribute("unitRef").alias("unit"), _attribute("decimals").alias("decimals"), F.coalesce(F.lower(_attribute("nil", XSI)).isin("true", "1"), F.lit(False)).alias("nil"), F.col("text").alias("value"))
    kind = F.when(F.col("unit").isNotNull(), "numeric").when(F.col("name").endswith("TextBlock") | F.col("value").rlike(r"<[A-Za-z][^>]*>"), "text block").otherwise("text")
    known = found.join(concept_ids(nodes), ["space", "name"], "left").withColumns({"kind": kind, "concept": F.coalesce("concept", F.concat_ws("_", "prefix", "name"))})
    return known.join(contexts(nodes), ["path", "context"], "left").join(units(nodes), ["path", "unit"], "left").select("path", "node", "concept", "kind", F.when(~F.col("nil"), F.col("value")).alias("value"), "decimals", "nil", "context", "entity", "scheme", "instant", "start", "end", "dimensions", "measure")


def _located(nodes: DataFrame) -> DataFrame:
    """path, parent (the extended link), at (locator's label), concept (the fragment that it points to)."""
    return nodes.where(_is(LINKS, "loc")).select("path", "parent", _attribute("label", XLINK).alias("at"), F.substring_index(_attribute("href", XLINK), "#", -1).alias("concept"))


def _arcs(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(_is(LINKS, name)).select(
        "path", "parent", _attribute("from", XLINK).alias("from"), _attribute("to", XLINK).alias("to"), F.coalesce(_attribute("order").try_cast("double"), F.lit(1.0)).alias("place"),
        _attribute("preferredLabel").alias("preferred"), F.coalesce(_attribute("priority").try_cast("int"), F.lit(0)).alias("priority"), F.coalesce(_attribute("use") == "prohibited", F.lit(False)).alias("prohibited"),
    )


def concept_labels(nodes: DataFrame) -> DataFrame:
    """concept, role, lang, label of label linkbases; prohibited arcs name nothing."""
    resources = nodes.where(_is(LINKS, "label")).select("path", "parent", _attribute("label", XLINK).alias("to"), F.coalesce(_attribute("role", XLINK), F.lit(STANDARD_LABEL)).alias("role"), _attribute("lang", XML).alias("lang"), F.col("text").alias("label"))
    arcs = _arcs(nodes, "labelArc").where("NOT prohibited").select("path", "parent", "from", "to")
    return arcs.join(_located(nodes).withColumnRenamed("at", "from"), ["path", "parent", "from"]).join(resources, ["path", "parent", "to"]).select("concept", "role", "lang", "label").distinct()


def presentation_edges(nodes: DataFrame, lang: str = "en") -> DataFrame:
    """tree (the link's role), parent, child, place, label (of the arc's preferred role, or null); overridden arcs are gone."""
    roles = nodes.where(_is(LINKS, "presentationLink")).select("path", F.col("node").alias("parent"), _attribute("role", XLINK).alias("tree"))
    places = _located(nodes)
    arcs = _arcs(nodes, "presentationArc").join(roles, ["path", "parent"])
    ends = arcs.join(places.select("path", "parent", F.col("at").alias("from"), F.col("concept").alias("above")), ["path", "parent", "from"]).join(places.select("path", "parent", F.col("at").alias("to"), F.col("concept").alias("child")), ["path", "parent", "to"])
    said = concept_labels(nodes).where(F.lower(F.substring("lang", 1, 2)) == lang).groupBy(F.col("concept").alias("child"), F.col("role").alias("preferred")).agg(F.min("label").alias("label"))
    rows = ends.select("tree", F.col("above"), "child", "place", "priority", "prohibited", "preferred").join(said, ["child", "preferred"], "left")
    return effective_edges(rows.withColumnRenamed("above", "parent"))


def standard_labels(nodes: DataFrame, lang: str = "en") -> DataFrame:
    """node (a concept), label: its standard label in the language."""
    return concept_labels(nodes).where((F.col("role") == STANDARD_LABEL) & (F.lower(F.substring("lang", 1, 2)) == lang)).groupBy(F.col("concept").alias("node")).agg(F.min("label").alias("label"))


def presented_facts(found: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """found (facts()) with label and tree, depth, labels, places: a row for each place of its concept in a tree; facts without one stay once."""
    walked = walk_trees(edges, labels).where("NOT cycle").select("tree", F.col("node").alias("concept"), "depth", "labels", "places")
    return found.join(labels.withColumnRenamed("node", "concept"), "concept", "left").join(walked, "concept", "left")


def key_values(found: DataFrame, labels: DataFrame) -> DataFrame:
    """path, place, key, value: numeric facts and texts as pairs, in the order of the file; key: the label, or the concept."""
    named = found.where("kind <> 'text block' AND NOT nil").join(labels.withColumnRenamed("node", "concept"), "concept", "left")
    return named.select("path", F.col("node").alias("place"), F.coalesce("label", "concept").alias("key"), "value")


def text_blocks(found: DataFrame) -> DataFrame:
    """path, place, concept, text: narrative facts without their mark-up."""
    bare = F.regexp_replace(F.regexp_replace("value", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return found.where("kind = 'text block' AND NOT nil").select("path", F.col("node").alias("place"), "concept", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))


def markdown_lines(found: DataFrame, labels: DataFrame) -> DataFrame:
    """path, place, line: text blocks as paragraphs under their concept's heading, pairs as list items."""
    pairs = key_values(found, labels).select("path", "place", F.concat(F.lit("- "), "key", F.lit(": "), "value").alias("line"))
    blocks = text_blocks(found).join(labels.withColumnRenamed("node", "concept"), "concept", "left").select("path", "place", F.concat(F.lit("## "), F.coalesce("label", "concept"), F.lit("\n\n"), "text").alias("line"))
    return pairs.unionByName(blocks)
