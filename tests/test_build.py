import json

import numpy as np
import pytest

from quadweave import vocab as V
from quadweave.emit import text
from quadweave.operators.derive import Options, derive
from quadweave.operators.links import Route, resolve
from quadweave.sources import artifacts, markdown

GUIDE = """---
title: Guide
tags: [setup, "Two Words"]
authors: [Ann, Bo]
date: 2024-03-01
type: how-to
translation-of: ../b.md
kg:
  label: Install
  broader: Topics
  applies-to: X100
  sections:
    steps: {type: task, concepts: Steps}
    nowhere: {type: task}
  provenance:
    - {generated-by: m1, fields: [label, broader], confidence: {label: 0.876}}
---
# Guide *one*

See [b](../b.md#end), [gone](gone.md), <https://Example.com>, [ref][r] and `[no](x.md)`.

## Steps
```python
# not a heading
```
## Steps
![pic](img/a%20b.png)

[r]: ../B
"""


def model(spark, **files):
    rows = [(k.replace("__", "/").replace("_md", ".md"), v) for k, v in files.items()]
    return markdown.parse(spark.createDataFrame(rows, "path string, content string"))


def triples(df):
    return {(r["s"].removeprefix("urn:quadweave:"), V.PREFIXES and text._compact(r["p"]), r["o_value"].removeprefix("urn:quadweave:")) for r in df.collect()}


@pytest.fixture(scope="module")
def built(spark):
    return derive(model(spark, a__guide_md=GUIDE, b_md="Title\n=====\n\n# End\n"), Options(qualified=True)).cache()


def test_parse():
    row = dict(zip(("path", "present", "one", "many", "kg_sections", "provenance", "first_h1", "sections", "links", "images", "code"), markdown.analyse("a/guide.md", GUIDE), strict=False))
    assert row["one"]["date"] == "2024-03-01" and row["many"]["tags"] == ["setup", "Two Words"] and row["one"]["kg.label"] == "Install"
    assert row["first_h1"] == "Guide one" and row["code"] == ["python"] and row["images"] == ["img/a%20b.png"]
    assert row["sections"] == [("guide-one", "Guide one", 1, 1, None), ("steps", "Steps", 2, 1, "guide-one"), ("steps-1", "Steps", 2, 2, "guide-one")]
    assert row["links"] == ["../b.md#end", "gone.md", "https://Example.com", "../B"]
    assert markdown.analyse("x.md", "+++\nn = 3\nb = true\n+++\n")[2:4] == ({"n": "3", "b": None}, {"n": [], "b": []})
    assert markdown.analyse("x.mdx", '<Card href="/y" />\n<img src={"z.png"} />')[8:10] == (["/y"], ["z.png"])


def test_bad_frontmatter_is_an_error_row(spark):
    assert [(r["path"], r["error"] is not None) for r in model(spark, x_md="---\na: [1\n---\n").collect()] == [("x.md", True)]


def test_derive(built):
    got = triples(built)
    doc = "doc/a/guide.md"
    assert {
        (doc, "rdf:type", "ns#Document"), (doc, "dcterms:title", "Guide"), (doc, "dcterms:created", "2024-03-01"), (doc, "dcterms:references", "doc/b.md#end"), (doc, "dcterms:references", "doc/b.md"),
        (doc, "qw:brokenLink", "gone.md"), (doc, "dcterms:references", "https://example.com/"), (doc, "dcterms:subject", "concept/two-words"), (doc, "foaf:primaryTopic", "concept/install"),
        ("concept/install", "skos:broader", "concept/topics"), (doc, "iirds:has-topic-type", V.iri("iirds:GenericTask")), (doc, "iirds:relates-to-product-variant", "product/x100"),
        (doc, "schema:translationOfWork", "doc/b.md"), ("doc/b.md", "schema:workTranslation", doc), (doc, "qw:brokenSection", "nowhere"), (f"{doc}#steps", "dcterms:subject", "concept/steps"),
        (f"{doc}#guide-one", "dcterms:hasPart", f"{doc}#steps"), (f"{doc}#steps-1", "qw:order", "2"), (doc, "qw:codeLanguage", "python"), (doc, "prov:wasAttributedTo", "agent/person/ann"),
        (f"{doc}#prov.kg-fill.m1", "prov:generated", "concept/install"), (f"{doc}#prov.kg-fill.m1.field.label", "qw:confidence", "0.88"), ("activity/build", "prov:used", "doc/b.md"), ("scheme", "rdf:type", V.iri("skos:ConceptScheme")),
        ("doc/b.md", "dcterms:title", "Title"), (doc, "prov:qualifiedAttribution", f"{doc}#prov.attribution.ann"),
    } <= got
    assert not any(s == f"{doc}#steps-1" and p == "iirds:has-topic-type" for s, p, _ in got) and built.count() == len(got)


def test_routes(spark):
    rows = [("d/a.md", x) for x in ("/docs/b", "/docs/x/", "/docs/none", "/else/b", "/docs/f.zip", "#top", "b.md#s", "../../up.md", "c.pdf", "STOPrecord", "stop-record", "mailto:x@y.z")]
    paths = spark.createDataFrame([(x,) for x in ("d/a.md", "d/b.md", "d/x/index.md", "d/stopRecord.mdx")], "path string")
    got = {r["raw"]: (r["kind"], r["resolved"], r["anchor"]) for r in resolve(spark.createDataFrame(rows, "path string, raw string"), paths, [Route("/docs", "d", "en")]).collect()}
    assert got == {
        "/docs/b": ("internal", "d/b.md", None), "/docs/x/": ("internal", "d/x/index.md", None), "/docs/none": ("broken", None, None), "b.md#s": ("internal", "d/b.md", "s"),
        "../../up.md": ("broken", None, None), "STOPrecord": ("internal", "d/stopRecord.mdx", None), "stop-record": ("internal", "d/stopRecord.mdx", None), "mailto:x@y.z": ("external", None, None),
    }


@pytest.mark.parametrize("form", ["turtle", "jsonld"])
def test_text_forms_round_trip(spark, built, tmp_path, form):
    odd = spark.createDataFrame([("urn:a b", V.TITLE, "literal", 'q"\\\n\té\U0001f600', None), ("urn:c", V.LEVEL, "literal", "-3", V.XSD_INTEGER)], V.QUADS)
    quads = built.union(odd if form == "jsonld" else odd.filter("s <> 'urn:a b'"))
    text.write(quads, str(tmp_path / "g"), form)
    back = artifacts.read_graph(spark, str(tmp_path / "g"), form)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, quads.collect()), key=str)
    text.write(quads.repartition(3), str(tmp_path / "h"), form)
    assert (tmp_path / "g").read_bytes() == (tmp_path / "h").read_bytes()


def test_turtle_terms(spark):
    q = spark.createDataFrame([("urn:a b", V.TITLE, "literal", 'q"\\\n', None), ("urn:a b", V.RDF_TYPE, "iri", V.DOCUMENT, None), ("urn:a b", V.LEVEL, "literal", "3", V.XSD_INTEGER)], V.QUADS)
    assert "".join(text.turtle(q)).split("\n\n", 1)[1] == '<urn:a%20b> a qw:Document ;\n  dcterms:title "q\\"\\\\\\n" ;\n  qw:level 3 .\n'
    with pytest.raises(ValueError):
        text.write(q, "/tmp/none", "other")


def test_rdf_xml(spark, built):
    import xml.etree.ElementTree as ET

    root = ET.fromstring("".join(text.rdf_xml(built)))
    assert len(root) == built.select("s").distinct().count() and sum(len(x) for x in root) == built.count()
    with pytest.raises(text.UncoveredPredicate):
        list(text.rdf_xml(spark.createDataFrame([("s", "urn:none", "iri", "o", None)], V.QUADS)))


def test_json_ld_shape(built):
    data = json.loads("".join(text.json_ld(built)))
    ids = [x["@id"] for x in data["@graph"]]
    assert ids == sorted(ids) and data["@context"]["skos"] == V.PREFIXES["skos"]


def test_vectors():
    data = artifacts.pack_vectors([("b", [0, 2]), ("a", [3, 4]), ("c", [0, 0])], "m", "q8", "d")
    header, rows = artifacts.unpack_vectors(data)
    assert header["ids"] == ["a", "b", "c"] and np.allclose(rows, [[0.6, 0.8], [0, 1], [0, 0]])
    for bad in (b"", b"x" * 20, data[:-1], data[:4] + b"\1" + data[5:], data[:12] + b"!" + data[13:]):
        with pytest.raises(artifacts.VectorFileError):
            artifacts.unpack_vectors(bad)


def test_bad_turtle():
    for bad in ("<a> <b> [] .", "<a> <b> ", "x:a <b> <c> .", '<a> <b> "t"@en .'):
        with pytest.raises(artifacts.GraphError):
            list(artifacts.parse_turtle(bad))


def test_pages_are_dealt_out_and_read_in_few_scans(spark):
    parsed = markdown.parse(spark.createDataFrame([("a.md", "# A"), ("b.md", "# B")], "path string, content string").coalesce(1))
    assert parsed.rdd.getNumPartitions() > 1
    assert derive(parsed, Options(qualified=True))._jdf.queryExecution().optimizedPlan().collectLeaves().size() < 30


def test_what_two_sources_say_is_said_once(spark):
    page = '+++\nauthors = ["Ann", "ann", "Bo"]\ntags = ["Two Words", "two words"]\n+++\n![p](i.png) ![p](./i.png)\n'
    git = spark.createDataFrame([("a.md", "2023-05-01T00:00:00Z", None, ["ANN", "Cy"], ["b.md"])], "path string, created string, modified string, authors array<string>, renamed_from array<string>")
    files = spark.createDataFrame([("a.md", page), ("./a.md", page), ("b.md", "# B")], "path string, content string")
    for rows in (files, files.filter("path <> './a.md'")):
        got = [tuple(r) for r in derive(markdown.parse(rows), Options(qualified=True, git=git)).collect()]
        assert len(got) == len(set(got))
        assert sorted(o.rpartition("/")[2] for _, p, _, o, _ in got if p == V.CREATOR) == ["ann", "bo", "cy"]
        assert sorted(o for _, p, _, o, _ in got if p == V.iri("foaf:name")) == ["ANN", "Ann", "Bo", "Cy", "ann", "quadweave"]


def test_turtle_triples_meet_once_and_show_once(spark):
    rows = [("urn:s", V.REFERENCES, "iri", "urn:b", None), ("urn:s", V.REFERENCES, "iri", "urn:a", None), ("urn:s", V.REFERENCES, "iri", "urn:b", None), ("urn:s", V.RDF_TYPE, "iri", V.DOCUMENT, None)]
    blocks = text.turtle_blocks(spark.createDataFrame(rows, V.QUADS))
    assert blocks.first()["block"].split(" ;\n  ") == [f"<urn:s> a {text._compact(V.DOCUMENT)}", "dcterms:references <urn:a>, <urn:b> ."]
