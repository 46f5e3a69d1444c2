import datetime
import xml.etree.ElementTree as ET

import pytest

from quillstrata.operators import trees
from quillstrata.sources import xbrl

X, L, K, D = (f"{{{s}}}" for s in (xbrl.INSTANCE, xbrl.LINKS, xbrl.XLINK, xbrl.DIMENSIONS))
INSTANCE = """<?xml version="1.0"?>
<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:b="urn:bank" xmlns:o="urn:other" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:iso4217="u" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
  <xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="cik">19617</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>2025-12-31</xbrli:instant></xbrli:period></xbrli:context>
  <xbrli:context id="c2"><xbrli:entity><xbrli:identifier scheme="cik">19617</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="b:Axis">b:Cards</xbrldi:explicitMember><xbrldi:typedMember dimension="b:AAxis"><b:key>k1</b:key></xbrldi:typedMember></xbrli:segment></xbrli:entity>
    <xbrli:period><xbrli:startDate>2025-01-01</xbrli:startDate><xbrli:endDate>2025-12-31T00:00:00</xbrli:endDate></xbrli:period></xbrli:context>
  <xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>
  <xbrli:unit id="eps"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>
  <b:Assets contextRef="c1" unitRef="usd" decimals="-6">1000</b:Assets>
  <b:Loans contextRef="c2" unitRef="usd" decimals="0">40</b:Loans>
  <b:Eps contextRef="c2" unitRef="eps" decimals="2">1.5</b:Eps>
  <b:Cash contextRef="c1" unitRef="usd" xsi:nil="true"/>
  <o:PolicyTextBlock contextRef="c2">&lt;p&gt;We &lt;b&gt;lend&lt;/b&gt;&lt;/p&gt;</o:PolicyTextBlock>
  <b:Name contextRef="missing">Bank &amp; Co</b:Name>
</xbrli:xbrl>"""
SCHEMA = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:bank">' + "".join(f'<xs:element name="{n}" id="bank_{n}"/>' for n in ("Assets", "Loans", "Eps", "Cash", "Name", "Sheet")) + "</xs:schema>"
_LOC = '<link:loc xlink:label="{0}" xlink:href="bank.xsd#bank_{0}"/>'
_ROOT = '<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink">{}</link:linkbase>'
LABELS = _ROOT.format(
    '<link:labelLink>' + "".join(_LOC.format(n) + f'<link:labelArc xlink:from="{n}" xlink:to="l_{n}"/><link:label xlink:label="l_{n}" xlink:role="http://www.xbrl.org/2003/role/label" xml:lang="en-US">{n} label</link:label>' for n in ("Assets", "Loans", "Cash", "Sheet"))
    + '<link:label xlink:label="l_Assets" xlink:role="http://www.xbrl.org/2003/role/totalLabel" xml:lang="en-US">Total assets</link:label><link:label xlink:label="l_Assets" xml:lang="de">Aktiva</link:label></link:labelLink>'
)
PRESENTATION = _ROOT.format(
    '<link:presentationLink xlink:role="urn:sheet">' + "".join(map(_LOC.format, ("Sheet", "Assets", "Loans", "Cash")))
    + '<link:presentationArc xlink:from="Sheet" xlink:to="Assets" order="2" preferredLabel="http://www.xbrl.org/2003/role/totalLabel"/><link:presentationArc xlink:from="Assets" xlink:to="Loans" order="1"/><link:presentationArc xlink:from="Sheet" xlink:to="Loans" order="1"/>'
    '<link:presentationArc xlink:from="Sheet" xlink:to="Cash" order="3"/><link:presentationArc xlink:from="Sheet" xlink:to="Cash" order="3" use="prohibited" priority="1"/></link:presentationLink>'
)


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("xbrl")
    for name, text in (("i.xml", INSTANCE), ("s.xsd", SCHEMA), ("lab.xml", LABELS), ("pre.xml", PRESENTATION)):
        (folder / name).write_text(text)
    return xbrl.read_nodes(spark, str(folder)).cache()


def test_nodes_equal_a_plain_parser(nodes):
    got = {r.node: r for r in nodes.where("path LIKE '%/i.xml'").collect()}
    root = ET.fromstring(INSTANCE)
    order = list(root.iter())
    parent = {c: p for p in order for c in p}
    assert len(got) == len(order)
    for i, x in enumerate(order):
        r = got[i]
        assert f"{{{r.space}}}{r.name}" == x.tag and r.attributes == x.attrib and r.text == (x.text or "").strip()
        assert r.parent == (order.index(parent[x]) if x in parent else None)


def test_facts_equal_a_plain_parser(nodes):
    root = ET.fromstring(INSTANCE)
    contexts = {}
    for c in root.findall(f"{X}context"):
        day = lambda tag, c=c: (lambda e: datetime.date.fromisoformat(e.text[:10]) if e is not None else None)(c.find(f".//{X}{tag}"))
        dims = [(m.get("dimension"), m.text) for m in c.iter(f"{D}explicitMember")] + [(m.get("dimension"), m[0].text) for m in c.iter(f"{D}typedMember")]
        contexts[c.get("id")] = (c.find(f".//{X}identifier").text, day("instant"), day("startDate"), day("endDate"), sorted(dims))
    measure = {"usd": "iso4217:USD", "eps": "iso4217:USD/xbrli:shares", None: None}
    want = set()
    for x in root:
        if x.get("contextRef"):
            space, name = x.tag[1:].split("}")
            entity, *days, dims = contexts.get(x.get("contextRef"), (None, None, None, None, None))
            nil = "true" in x.attrib.values()
            want.add(str(("bank_" + name if space == "urn:bank" else "o_" + name, None if nil else x.text or "", nil, entity, *days, dims, measure[x.get("unitRef")])))
    rows = xbrl.facts(nodes).collect()
    assert {str((r.concept, r.value, r.nil, r.entity, r.instant, r.start, r.end, None if r.dimensions is None else [tuple(d) for d in r.dimensions], r.measure)) for r in rows} == want and len(rows) == 6
    assert {r.concept: r.kind for r in rows} == {"bank_Assets": "numeric", "bank_Loans": "numeric", "bank_Eps": "numeric", "bank_Cash": "numeric", "o_PolicyTextBlock": "text block", "bank_Name": "text"}


def test_trees_labels_and_texts(nodes):
    labels, edges = xbrl.standard_labels(nodes), xbrl.presentation_edges(nodes)
    assert {(r.node, r.label) for r in labels.collect()} == {(f"bank_{n}", f"{n} label") for n in ("Assets", "Loans", "Cash", "Sheet")}
    assert ("bank_Assets", "de", "Aktiva") in {(r.concept, r.lang, r.label) for r in xbrl.concept_labels(nodes).collect()}
    shown = xbrl.presented_facts(xbrl.facts(nodes), labels, edges)
    places = {(r.concept, r.value, tuple(r.labels or ())) for r in shown.collect()}
    assert places == {
        ("bank_Assets", "1000", ("Sheet label", "Total assets")), ("bank_Loans", "40", ("Sheet label", "Loans label")), ("bank_Loans", "40", ("Sheet label", "Total assets", "Loans label")),
        ("bank_Eps", "1.5", ()), ("bank_Cash", None, ()), ("o_PolicyTextBlock", "<p>We <b>lend</b></p>", ()), ("bank_Name", "Bank & Co", ()),
    }
    assert {(r.key, r.value) for r in xbrl.key_values(xbrl.facts(nodes), labels).collect()} == {("Assets label", "1000"), ("Loans label", "40"), ("bank_Eps", "1.5"), ("bank_Name", "Bank & Co")}
    assert [r.text for r in xbrl.text_blocks(xbrl.facts(nodes)).collect()] == ["We lend"]
    lines = [r.line for r in xbrl.markdown_lines(xbrl.facts(nodes), labels).orderBy("path", "place").collect()]
    assert lines[0] == "- Assets label: 1000" and lines[-2:] == ["## o_PolicyTextBlock\n\nWe lend", "- bank_Name: Bank & Co"]


def test_broken_files_are_named(spark, tmp_path):
    (tmp_path / "bad.xml").write_text("<a><b></a>")
    with pytest.raises(Exception, match="bad.xml: mismatched tag"):
        xbrl.read_nodes(spark, str(tmp_path)).collect()


def test_rings_end_and_shared_nodes_come_twice(spark):
    edges = spark.createDataFrame([("t", "r", "a", 1.0, None), ("t", "r", "b", 2.0, "B"), ("t", "a", "c", 1.0, None), ("t", "b", "c", 1.0, None), ("t", "c", "a", 1.0, None), ("u", "x", "y", 1.0, None), ("u", "y", "x", 1.0, None)], "tree string, parent string, child string, place double, label string")
    got = {("/".join(r.path), r.cycle) for r in trees.walk_trees(edges).collect()}
    assert got == {("r", False), ("r/a", False), ("r/b", False), ("r/a/c", False), ("r/b/c", False), ("r/a/c/a", True), ("r/b/c/a", False), ("r/b/c/a/c", True)}
    assert trees.walk_trees(edges.limit(0)).count() == 0
