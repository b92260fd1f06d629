from quadweave import quads as Q
from quadweave import vocab as V
from quadweave.operators import check, graph, retrieve, scope, search

ROWS = [
    ("a", V.REFERENCES, "iri", "b", None), ("b", V.REFERENCES, "iri", "c", None), ("c", V.REFERENCES, "iri", "a", None), ("a", V.REFERENCES, "iri", "d", None),
    ("a", V.APPLIES_TO, "iri", "x100", None), ("b", V.NOT_APPLIES_TO, "iri", "x100", None), ("d", V.APPLIES_TO, "iri", "y", None),
    ("x100", V.TITLE, "literal", "X 100", None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, V.QUADS)


def test_scope_reads_silence_as_unknown(spark):
    q = frame(spark)
    assert scope.resolve_variant(q, "x 100") == "x100"
    got = {r["iri"]: r["rule"] for r in scope.exclusions(q, variant="x100").collect()}
    assert got == {"b": "variant-negative", "d": "variant-not-listed"}


def test_traverse_keeps_back_edges_and_stops_at_excluded(spark):
    q = frame(spark)
    seed = spark.createDataFrame([("a",)], "iri string")
    t = graph.traverse(q, seed, depth=3, predicates=[V.REFERENCES])
    assert {(r["iri"], r["depth"]) for r in t.nodes.collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert ("c", "a") in {(r["s"], r["o"]) for r in t.hops.collect()}
    t = graph.traverse(q, seed, depth=3, predicates=[V.REFERENCES], excluded=scope.exclusions(q, variant="x100"))
    assert {r["iri"] for r in t.nodes.collect()} == {"a"}
    assert {r["iri"] for r in t.exclusions.collect()} == {"b", "d"}
    assert [r["iri"] for r in graph.traverse(q, seed, depth=3, predicates=[V.REFERENCES], limit=1).nodes.orderBy("depth").collect()] == ["a", "b"]


def test_cycles_and_related_conflicts(spark):
    q = frame(spark, [("a", V.BROADER, "iri", "b", None), ("c", V.NARROWER, "iri", "b", None), ("a", V.RELATED, "iri", "c", None), ("x", V.BROADER, "iri", "y", None), ("y", V.BROADER, "iri", "x", None)])
    assert {(r["iri"], r["component"]) for r in graph.cycles(graph.broader_edges(q)).collect()} == {("x", "x"), ("y", "x")}
    assert [tuple(r) for r in graph.related_conflicts(q).collect()] == [("a", "c")]


def test_a_node_between_two_cycles_is_on_none(spark):
    pairs = [("c", "d"), ("d", "c"), ("d", "a"), ("a", "e"), ("e", "f"), ("f", "e"), ("f", "b"), ("b", "b")]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    assert {(r["iri"], r["component"]) for r in graph.cycles(edges).collect()} == {("c", "c"), ("d", "c"), ("e", "e"), ("f", "e"), ("b", "b")}


def test_shapes(spark):
    q = frame(spark, [("a", V.RDF_TYPE, "iri", V.DOCUMENT, None), ("a", V.CREATED, "literal", "2024-13", V.XSD_DATE), ("a", V.APPLIES_TO, "iri", "v", None), ("a", V.NOT_APPLIES_TO, "iri", "v", None), ("a", "odd", "literal", "1", None)])
    shape = check.Shape(target_class=V.DOCUMENT, closed=True, properties=(check.Property(V.TITLE, min_count=1), check.Property(V.CREATED, datatype=V.XSD_DATE), check.Property(V.APPLIES_TO, disjoint=V.NOT_APPLIES_TO), check.Property(V.NOT_APPLIES_TO)))
    assert {(r["message"], r["path"]) for r in check.validate(q, [shape]).collect()} == {("closed", "odd"), ("minCount", V.TITLE), ("datatype", V.CREATED), ("disjoint", V.APPLIES_TO)}


def test_assemble_skips_what_is_too_long(spark):
    blocks = spark.createDataFrame([(1, "a", "x" * 5), (2, "b", "y" * 9), (3, "c", "z" * 4)], "seq int, iri string, content string")
    row = retrieve.assemble(blocks, 10).first()
    assert (row["iris"], row["used"], row["truncated"], row["refusal"]) == ("a,c", 9, True, None)


def test_sections(spark):
    text = "intro\n# T\nown\n## A\none\n```\n# no heading\n```\n## A\ntwo\n# U\nend"
    docs = spark.createDataFrame([("d", text)], "doc string, content string")
    got = {r["slug"]: r for r in retrieve.sections(docs).collect()}
    assert set(got) == {"t", "a", "a-1", "u"}
    assert got["t"]["own_text"] == "own" and got["t"]["subtree_text"].endswith("two") and got["a-1"]["occurrence"] == 1
    assert retrieve.preamble(docs).first()["text"] == "intro"


def test_search(spark):
    e = spark.createDataFrame([("a", "install guide", "words"), ("b", "other", "install words"), ("c", "other", "none")], "id string, title string, text string")
    assert [r["id"] for r in search.bm25(e, "install").collect()] == ["a", "b"]
    assert [r["id"] for r in search.bm25(e, "instal", prefix=True).collect()] == ["a", "b"]
    assert search.bm25(e, "instxll").count() == 0 and search.bm25(e, "instxll", fuzzy=0.2).count() == 2
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 2.0]), ("z", [-1.0, 0.0])], "id string, vector array<double>")
    assert [r["id"] for r in search.vector_top(v, [1.0, 0.0]).collect()] == ["x", "y"]


def test_dedupe_and_match(spark):
    q = frame(spark).union(frame(spark))
    assert Q.dedupe(q).count() == len(ROWS)
    assert Q.match(Q.dedupe(q), p="dcterms:title").first()["o_value"] == "X 100"
