"""A Markdown corpus over the parts table, and what the derivation rules must make of it, in SQL.

Every part is a page; every fifth has a German translation.  The pages exercise
all rules: page keys, the ``kg`` block, sections, links of all kinds, images,
code, provenance and git facts.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import check, derive, graph, retrieve, scope, stats
from ..operators.links import Route
from ..sources import markdown
from ..sources import relational as R
from ..functions import scalars as S
from ..store import cut
from .kg import query

_B = "urn:quadweave:"
ROUTES = (Route("/docs", "docs", "en"), Route("/de", "de", "de"))


def _cond(where: str, text: str) -> Column:
    """The text, with ``{sql}`` as values, where the condition holds; else nothing."""
    parts, out = text.split("§"), []
    for i, part in enumerate(parts):
        out.append(F.expr(f"cast({part} as string)") if i % 2 else F.lit(part))
    return F.when(F.expr(where), F.concat(*out)).otherwise(F.lit(""))


#: Lines of a page and when they are there; what stands between section signs is SQL.
_PAGE = [
    ("true", "+++\n"),
    ("k % 7 <> 0", 'title = "Part §k§"\n'),
    ("true", 'description = "§p_type§"\nauthors = ["Ann §k % 11§", "Bo §k % 3§"]\ndate = "2024-01-§10 + k % 20§"\n'),
    ("k % 2 = 0", 'updated = "2024-02-01T10:00:00Z"\n'),
    ("k % 3 = 0", 'lang = "fr"\n'),
    ("true", 'tags = ["§p_brand§"]\nkeywords = ["Key §k % 4§"]\n'),
    ("k % 4 = 0", 'type = "how-to"\n'),
    ("k % 4 = 1", 'applies-to = "V§k % 3§"\n'),
    ("k % 6 = 0", 'generated-by = "model x"\n'),
    ("k % 10 = 0", 'supersedes = "p§k + 1§.md"\n'),
    ("true", '[kg]\nlabel = "Topic §k % 20§"\nalt-labels = ["Alias §k % 5§"]\nbroader = ["Topic §(k + 1) % 20§"]\nconcepts = ["Idea §k % 9§"]\nderived-from = "../docs/p§k + 2§.md"\n'),
    ("k % 3 = 1", 'narrower = "Topic §(k + 2) % 20§"\nrelated-concepts = ["Topic §(k + 3) % 20§"]\n'),
    ("k % 4 = 2", 'type = "task"\n'),
    ("k % 4 = 3", 'applies-to = ["V§k % 3§"]\nnot-applicable-to = ["V9"]\n'),
    ("k % 8 = 0", 'about-product-lifecycle = ["update"]\n'),
    ("k % 8 = 1", 'about-product-aspect = ["system-requirement"]\n'),
    ("k % 8 = 2", 'not-about-product-aspect = "architecture"\n'),
    ("k % 12 = 0", '[kg.sections.usage]\ntype = "concept"\nconcepts = ["Idea 0"]\n[kg.sections.nowhere]\ntype = "task"\n'),
    ("k % 9 = 0", '[[kg.provenance]]\ngenerated-by = "Fill 1"\nfields = ["label", "concepts"]\nconfidence = { label = 0.857 }\n'),
    ("true", "+++\nBefore.\n\n# Part §k§\n\nSee [next](p§k + 1§.md#usage), [abs](/docs/p§k + 3§), [lost](missing/x§k§.md), <HTTPS://Example.COM:443>, [ref][r], [file](a.zip), [here](#usage).\n"),
    ("true", "\n![in](img/i%20§k % 2§.png) ![ext](https://e.org/i.png)\n\n## Usage\n\n```x``` is no fence.\n\n~~~sql extra\n# no heading\n~~~\n\nUsage\n-----\n\n# Usage-1 #\n\n[r]: ../docs/P§case when k % 2 = 0 then '' else '_' end§§k + 4§\n"),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)`` of all pages."""
    part = R.read(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    pages = part.select(F.concat(F.lit("docs/p"), "k", F.lit(".md")).alias("path"), F.concat(*(_cond(*x) for x in _PAGE)).alias("content"))
    german = part.filter("k % 5 = 0").select(F.concat(F.lit("de/p"), "k", F.lit(".md")).alias("path"), F.concat(F.lit('+++\ntranslation-of = "../docs/p'), "k", F.lit('.md"\n+++\n# Teil '), "k", F.lit("\n")).alias("content"))
    return pages.unionByName(german)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Git facts of every eighth page and of all translations."""
    part = R.read(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    facts = [F.lit("2023-05-01T00:00:00Z").alias("created"), F.lit("2023-06-01T00:00:00Z").alias("modified"), F.array(F.lit("Git Person")).alias("authors")]
    old = F.array(F.concat(F.lit("old/p"), "k", F.lit(".md"))).alias("renamed_from")
    page = part.filter("k % 8 = 0").select(F.concat(F.lit("docs/p"), "k", F.lit(".md")).alias("path"), *facts, old)
    german = part.filter("k % 5 = 0").select(F.concat(F.lit("de/p"), "k", F.lit(".md")).alias("path"), *facts, F.array().cast("array<string>").alias("renamed_from"))
    return page.unionByName(german)


@lru_cache(maxsize=4)
def graph_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of the corpus, all rules on, derived once in a session."""
    options = derive.Options(routes=ROUTES, qualified=True, git=history(spark, sf_dir), tool_version="1.0", head_time="2024-03-01T00:00:00Z")
    return cut(derive.derive(markdown.parse(files(spark, sf_dir)), options))


# what the rules must give, in SQL over d(k, doc) and g(k, doc), the pages and the translations


def _l(p: str, o: str, where: str = "true", s: str = "doc", of: str = "d") -> str:
    return f"select {s} as s, '{V.iri(p)}' as p, 'iri' as o_kind, {o} as o_value, null as o_datatype from {of} where {where}"


def _f(p: str, o: str, where: str = "true", s: str = "doc", of: str = "d", kind: str | None = None) -> str:
    return f"select {s}, '{V.iri(p)}', 'literal', cast({o} as varchar), {f"'{V.iri(kind)}'" if kind else 'null'} from {of} where {where}"


def _c(text: str) -> str:
    return f"'{V.iri(text)}'"


def _concept(label: str, where: str = "true", of: str = "d") -> list[str]:
    """A concept by its label, which has letters, digits and spaces only (or a ``#``, which goes)."""
    s = _minted("concept", label)
    return [_l("rdf:type", _c("skos:Concept"), where, s, of), _l("skos:inScheme", f"'{_B}scheme'", where, s, of), _f("skos:prefLabel", label, where, s, of)]


def _minted(kind: str, label: str) -> str:
    return f"'{_B}{kind}/' || replace(replace(lower({label}), '#', ''), ' ', '-')"


def _agent(label: str, kind: str, folder: str, where: str = "true", of: str = "d") -> list[str]:
    s = _minted(f"agent/{folder}", label)
    return [_l("rdf:type", _c(f"prov:{kind}"), where, s, of), _f("foaf:name", label, where, s, of)]


def _author(label: str, where: str = "true", of: str = "d") -> list[str]:
    a, node = _minted("agent/person", label), f"doc || '#prov.attribution.' || replace(lower({label}), ' ', '-')"
    return [
        *_agent(label, "Person", "person", where, of), _l("dcterms:creator", a, where, of=of), _l("prov:wasAttributedTo", a, where, of=of), _l("prov:qualifiedAttribution", node, where, of=of),
        _l("rdf:type", _c("prov:Attribution"), where, node, of), _l("prov:agent", a, where, node, of), _l("prov:hadRole", _c("qw:author"), where, node, of),
    ]


def _associated(activity: str, label: str, role: str, where: str = "true", of: str = "d") -> list[str]:
    a, node = _minted("agent/software", label), f"{activity} || '.assoc.' || replace(lower({label}), ' ', '-')"
    return [
        *_agent(label, "SoftwareAgent", "software", where, of), _l("rdf:type", _c("prov:Activity"), where, activity, of), _l("prov:wasAssociatedWith", a, where, activity, of), _l("prov:qualifiedAssociation", node, where, activity, of),
        _l("rdf:type", _c("prov:Association"), where, node, of), _l("prov:agent", a, where, node, of), _l("prov:hadRole", _c(f"qw:{role}"), where, node, of),
    ]


def _variant(p: str, label: str, where: str) -> list[str]:
    s = _minted("product", label)
    return [_l(p, s, where), _l("rdf:type", _c("iirds:ProductVariant"), where, s), _f("dcterms:title", label, where, s)]


def _page(k: str) -> str:
    return f"'{_B}doc/docs/p' || ({k}) || '.md'"


_TEXT = " || ".join("case when " + where + " then " + " || ".join(f"cast({x} as varchar)" if i % 2 else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for i, x in enumerate(text.split("§"))) + " else '' end" for where, text in _PAGE)
_DE_TEXT = "'+++' || chr(10) || 'translation-of = \"../docs/p' || k || '.md\"' || chr(10) || '+++' || chr(10) || '# Teil ' || k || chr(10)"
_FILL, _GEN = "doc || '#prov.kg-fill.fill-1'", "doc || '#prov.generation'"
_ONE = "(select 1)"


def _targets(p: str, far: str, raw: str, where: str = "true") -> list[str]:
    return [_l(p, _page(far), f"({where}) and {far} < n"), _f("qw:brokenLink", raw, f"({where}) and {far} >= n")]


_PARTS = [
    # identity of both kinds of pages
    *(x for of, path, text in (("d", "'docs/p' || k || '.md'", _TEXT), ("g", "'de/p' || k || '.md'", _DE_TEXT)) for x in (
        _l("rdf:type", _c("qw:Document"), of=of), _l("rdf:type", _c("prov:Entity"), of=of), _f("qw:path", path, of=of), _f("qw:contentHash", f"sha256({text})", of=of), _l("prov:used", "doc", s=f"'{_B}activity/build'", of=of),
    )),
    # page keys
    _f("dcterms:title", "'Part ' || k"), _f("dcterms:title", "'Teil ' || k", of="g"), _f("dcterms:description", "p_type"), _f("dcterms:language", "case when k % 3 = 0 then 'fr' else 'en' end"), _f("dcterms:language", "'de'", of="g"),
    *_author("'Ann ' || (k % 11)"), *_author("'Bo ' || (k % 3)"),
    _f("dcterms:created", "'2024-01-' || (10 + k % 20)", kind="xsd:date"), _f("prov:generatedAtTime", "'2024-01-' || (10 + k % 20)", kind="xsd:date"), _f("dcterms:modified", "'2024-02-01T10:00:00Z'", "k % 2 = 0", kind="xsd:dateTime"),
    _l("schema:translationOfWork", _page("k"), of="g"), _l("schema:workTranslation", "doc", s=_page("k"), of="g"),
    # hierarchy and typing
    *_concept("'Topic ' || (k % 20)"), _l("foaf:primaryTopic", _minted("concept", "'Topic ' || (k % 20)")), _f("skos:altLabel", "'Alias ' || (k % 5)", s=_minted("concept", "'Topic ' || (k % 20)")),
    *_concept("'Topic ' || ((k + 1) % 20)"), _l("skos:broader", _minted("concept", "'Topic ' || ((k + 1) % 20)"), s=_minted("concept", "'Topic ' || (k % 20)")),
    *_concept("'Topic ' || ((k + 2) % 20)", "k % 3 = 1"), _l("skos:narrower", _minted("concept", "'Topic ' || ((k + 2) % 20)"), "k % 3 = 1", _minted("concept", "'Topic ' || (k % 20)")),
    *_concept("'Topic ' || ((k + 3) % 20)", "k % 3 = 1"), _l("skos:related", _minted("concept", "'Topic ' || ((k + 3) % 20)"), "k % 3 = 1", _minted("concept", "'Topic ' || (k % 20)")),
    _l("iirds:has-topic-type", _c("iirds:GenericTask"), "k % 4 in (0, 2)"), *_variant("iirds:relates-to-product-variant", "'V' || (k % 3)", "k % 4 in (1, 3)"), *_variant("qw:notApplicableTo", "'V9'", "k % 4 = 3"),
    _l("iirds:relates-to-product-lifecycle-phase", _c("iirdsSft:Update"), "k % 8 = 0"), _l("iirds:has-subject", _c("iirdsSft:SystemRequirement"), "k % 8 = 1"), _l("qw:notAboutSubject", _c("iirdsSft:Architecture"), "k % 8 = 2"),
    # subjects
    *(x for label in ("p_brand", "'Idea ' || (k % 9)") for x in (*_concept(label), _l("dcterms:subject", _minted("concept", label)))),
    # sections
    *(x for slug, title, level, place, parent in (("part-' || k || '", "'Part ' || k", 1, 1, "doc"), ("usage", "'Usage'", 2, 1, "doc || '#part-' || k"), ("usage-1", "'Usage'", 2, 2, "doc || '#part-' || k"), ("usage-1-1", "'Usage-1'", 1, 2, "doc")) for x in (
        _l("rdf:type", _c("qw:Section"), s=f"doc || '#{slug}'"), _f("dcterms:title", title, s=f"doc || '#{slug}'"), _f("qw:level", str(level), s=f"doc || '#{slug}'", kind="xsd:integer"), _f("qw:order", str(place), s=f"doc || '#{slug}'", kind="xsd:integer"),
        _l("dcterms:hasPart", f"doc || '#{slug}'", s=parent),
    )),
    _l("rdf:type", _c("qw:Section"), s="doc || '#teil-' || k", of="g"), _f("dcterms:title", "'Teil ' || k", s="doc || '#teil-' || k", of="g"), _f("qw:level", "1", s="doc || '#teil-' || k", of="g", kind="xsd:integer"),
    _f("qw:order", "1", s="doc || '#teil-' || k", of="g", kind="xsd:integer"), _l("dcterms:hasPart", "doc || '#teil-' || k", of="g"),
    _l("iirds:has-topic-type", _c("iirds:GenericConcept"), "k % 12 = 0", "doc || '#usage'"), _l("dcterms:subject", _minted("concept", "'Idea 0'"), "k % 12 = 0", "doc || '#usage'"), *_concept("'Idea 0'", "k % 12 = 0"), _f("qw:brokenSection", "'nowhere'", "k % 12 = 0"),
    # links, images, code
    _l("dcterms:references", _page("k + 1") + " || '#usage'", "k + 1 < n"), _f("qw:brokenLink", "'p' || (k + 1) || '.md#usage'", "k + 1 >= n"), _l("dcterms:references", _page("k + 3"), "k + 3 < n"), _f("qw:brokenLink", "'/docs/p' || (k + 3)", "k + 3 >= n"),
    _f("qw:brokenLink", "'missing/x' || k || '.md'"), _l("dcterms:references", "'https://example.com/'"), _l("dcterms:references", _page("k + 4"), "k + 4 < n"), _f("qw:brokenLink", "'../docs/P' || case when k % 2 = 0 then '' else '_' end || (k + 4)", "k + 4 >= n"),
    _l("schema:image", f"'{_B}file/docs/img/i%2520' || (k % 2) || '.png'"), _l("schema:image", "'https://e.org/i.png'"), _f("qw:codeLanguage", "'sql'"),
    # provenance
    *_targets("prov:wasDerivedFrom", "k + 2", "'../docs/p' || (k + 2) || '.md'"), *_targets("prov:wasRevisionOf", "k + 1", "'p' || (k + 1) || '.md'", "k % 10 = 0"),
    _l("prov:wasGeneratedBy", _GEN, "k % 6 = 0"), *_associated(_GEN, "'model x'", "generator", "k % 6 = 0"), *_associated(_FILL, "'Fill 1'", "generator", "k % 9 = 0"),
    *(x for field in ("label", "concepts") for x in (_l("qw:filledFieldEntry", f"{_FILL} || '.field.{field}'", "k % 9 = 0", _FILL), _f("qw:filledField", f"'{field}'", "k % 9 = 0", f"{_FILL} || '.field.{field}'"))),
    _f("qw:confidence", "'0.86'", "k % 9 = 0", f"{_FILL} || '.field.label'", kind="xsd:decimal"), _l("prov:generated", _minted("concept", "'Topic ' || (k % 20)"), "k % 9 = 0", _FILL),
    # git
    _f("dcterms:modified", "'2023-06-01T00:00:00Z'", "k % 8 = 0 and k % 2 <> 0", kind="xsd:dateTime"), *_author("'Git Person'", "k % 8 = 0"), _l("prov:wasRevisionOf", f"'{_B}doc/old/p' || k || '.md'", "k % 8 = 0"), _l("rdf:type", _c("prov:Entity"), "k % 8 = 0", f"'{_B}doc/old/p' || k || '.md'"),
    _f("dcterms:created", "'2023-05-01T00:00:00Z'", of="g", kind="xsd:dateTime"), _f("prov:generatedAtTime", "'2023-05-01T00:00:00Z'", of="g", kind="xsd:dateTime"), _f("dcterms:modified", "'2023-06-01T00:00:00Z'", of="g", kind="xsd:dateTime"), *_author("'Git Person'", of="g"),
    # the build and the scheme
    _l("rdf:type", _c("prov:Entity"), s=f"'{_B}graph'", of=_ONE), _l("prov:wasGeneratedBy", f"'{_B}activity/build'", s=f"'{_B}graph'", of=_ONE), *_associated(f"'{_B}activity/build'", "'quadweave'", "tool", of=_ONE),
    _f("qw:version", "'1.0'", s=f"'{_B}agent/software/quadweave'", of=_ONE), _f("prov:endedAtTime", "'2024-03-01T00:00:00Z'", s=f"'{_B}activity/build'", of=_ONE, kind="xsd:dateTime"),
    _l("rdf:type", _c("skos:ConceptScheme"), s=f"'{_B}scheme'", of=_ONE), _f("dcterms:title", "'Concepts'", s=f"'{_B}scheme'", of=_ONE),
]
_WITH = (
    f"with d as (select p_partkey as k, {_page('p_partkey')} as doc, p_type, p_brand, (select count(*) from part) as n from part), g as (select k, '{_B}doc/de/p' || k || '.md' as doc from d where k % 5 = 0), "
    f"q as (select distinct * from ({' union all '.join(_PARTS)}))"
)


@query(f"{_WITH} select s, p, o_kind, o_value, o_datatype from q")
def q_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of the corpus."""
    return graph_of(spark, sf_dir)


@query(f"{_WITH} select b.o_value as target, p.o_value as path, case when b.p = {_c('qw:brokenLink')} then 'link' else 'section' end as kind from q b join q p on p.s = b.s and p.p = {_c('qw:path')} where b.p in ({_c('qw:brokenLink')}, {_c('qw:brokenSection')})")
def q_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.broken(graph_of(spark, sf_dir)).select("path", "kind", "target")


_TYPED = check.Shape(
    target_class=V.DOCUMENT, closed=True, ignored=tuple(V.iri(x) for x in ("rdf:type", "qw:path", "qw:contentHash", "dcterms:title", "dcterms:description", "dcterms:references", "dcterms:hasPart", "dcterms:subject", "schema:image", "foaf:primaryTopic", "schema:translationOfWork", "schema:workTranslation", "prov:wasDerivedFrom", "prov:wasRevisionOf", "prov:wasGeneratedBy", "prov:wasAttributedTo", "prov:qualifiedAttribution", "prov:generatedAtTime", "iirds:has-topic-type", "iirds:relates-to-product-variant", "iirds:relates-to-product-lifecycle-phase", "iirds:has-subject", "qw:notApplicableTo")),
    properties=(
        check.Property(V.CREATED, datatype=V.XSD_DATETIME, severity="warning"), check.Property(V.MODIFIED, datatype=V.XSD_DATETIME, min_count=1, severity="info", message="no date of change"), check.Property(V.CREATOR, max_count=2),
        check.Property(V.BROKEN_LINK, iri_only=True), check.Property(V.LANGUAGE, max_count=1, one_of=("en", "de")),
    ),
)


def _finding(severity: str, message: str, path: str, where: str) -> str:
    return f"select distinct '{severity}' as severity, '{message}' as message, q.s as focus, {_c(path)} as path from q join docs using (s) where {where}"


@query(
    f"{_WITH}, docs as (select s from q where p = '{V.RDF_TYPE}' and o_value = '{V.DOCUMENT}'), "
    f"n as (select s, count(*) filter (where p = {_c('dcterms:modified')}) as changed, count(*) filter (where p = {_c('dcterms:creator')}) as creators from q join docs using (s) group by s) "
    + " union all ".join([
        *(_finding("violation", "closed", p, f"p = {_c(p)}") for p in ("qw:brokenSection", "qw:codeLanguage", "qw:notAboutSubject")),
        _finding("warning", "datatype", "dcterms:created", f"p = {_c('dcterms:created')} and o_datatype <> '{V.XSD_DATETIME}'"), _finding("violation", "nodeKind", "qw:brokenLink", f"p = {_c('qw:brokenLink')}"),
        _finding("violation", "in", "dcterms:language", f"p = {_c('dcterms:language')} and o_value = 'fr'"),
        f"select 'info', 'no date of change', s, {_c('dcterms:modified')} from n where changed = 0", f"select 'violation', 'maxCount', s, {_c('dcterms:creator')} from n where creators > 2",
    ])
)
def q_typed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.ordered(check.validate(graph_of(spark, sf_dir), [_TYPED]))


@query("with recursive u as (select p_partkey as k, p_partkey // 4 as up from part where p_partkey > 0) select 'violation' as severity, 'broader cycle' as message, 'urn:kg:concept/' || k as focus, '" + V.BROADER + "' as path from (select k from u where k % 97 = 0 union select up from u where k % 97 = 0)")
def q_taxonomy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.taxonomy_findings(R.taxonomy(spark, sf_dir)).filter("message = 'broader cycle'")


@query(
    f"{_WITH}, out as (select distinct s from q where (p = {_c('qw:notApplicableTo')} and o_value = '{_B}product/v9')), r as (select doc as s, {_page('k + 1')} as o, k from d where k + 1 < n), "
    f"one as (select {_page('5')} as iri, 0 as depth union all select {_page('4')}, 1 where {_page('4')} not in (select s from out) union all select {_page('2')}, 1 where {_page('2')} not in (select s from out) union all select {_page('1')}, 1 where {_page('1')} not in (select s from out)) select * from one"
)
def q_scoped_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that refer to page 5 and apply to the variant: 1, 2 and 4; the excluded are met but not kept."""
    q = graph_of(spark, sf_dir)
    left_out = scope.exclusions(q, variant=scope.resolve_variant(q, "V9")).filter("rule = 'variant-negative'")
    seed = spark.createDataFrame([("urn:quadweave:doc/docs/p5.md",)], "iri string")
    fragments = q.filter(f"p = '{V.REFERENCES}'").select("s", "p", "o_kind", F.substring_index("o_value", "#", 1).alias("o_value"), "o_datatype")
    return graph.traverse(fragments, seed, 1, "in", [V.REFERENCES], excluded=left_out, limit=50).nodes.select("iri", "depth")


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\n"), "p_name", F.lit("\n# A, b\n"), "p_type", F.lit("\n~~~\n# no\n~~~\n## A b\n"), "p_brand", F.lit("\n# A-b-1\nEnd\n# A b\n"))
    return R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), text.alias("content"))


@query("select p_partkey as doc, p_name as text from part")
def q_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.preamble(_outline(spark, sf_dir))


_NL = "' || chr(10) || '"


@query(
    f"with t as (select p_partkey as doc, p_type || '{_NL}~~~{_NL}# no{_NL}~~~' as own, '## A b{_NL}' || p_brand as b, p_brand from part) "
    f"select doc, 'a-b' as slug, 0 as occurrence, '# A, b{_NL}' || own || '{_NL}' || b as subtree_text from t union all select doc, 'a-b-1', 0, b from t union all select doc, 'a-b-1-1', 0, '# A-b-1{_NL}End' from t union all select doc, 'a-b-2', 0, '# A b' from t"
)
def q_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose slugs clash with numbered ones, a fence with a heading, subtrees down to the next heading of the level."""
    return retrieve.sections(_outline(spark, sf_dir)).select("doc", "slug", "occurrence", "subtree_text")


@query(
    "select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) || case when starts_with(regexp_extract(url, '^[^:]+://[^/?#]*(.*)$', 1), '/') then '' else '/' end || regexp_extract(url, '^[^:]+://[^/?#]*(.*)$', 1) as href, "
    "url as decoded, replace(replace(lower(url), '-', ''), '_', '') as norm, 'a/' || page_id || '.md' as near, case when page_id % 3 = 0 then null else 'x' end as far, "
    "case page_id % 3 when 0 then 'http://www.w3.org/2001/XMLSchema#date' when 1 then 'http://www.w3.org/2001/XMLSchema#dateTime' end as typed, page_id % 2 = 0 as tag, 'dcterms:t' || page_id as short, page_id % 4 <> 1 as addresses from pages"
)
def q_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link, path, date, tag and name forms over every URL."""
    n = F.col("page_id")
    number = n.cast("string")
    far = F.when(n % 3 == 0, F.lit("../../../x")).otherwise(F.lit("../../x"))
    date = F.element_at(F.array(F.lit("2024-01-02"), F.lit("2024-01-02T03:04:05Z"), F.lit("2024-1-2")), (n % 3 + 1).cast("int"))
    target = F.element_at(F.array(F.lit("a/b"), F.lit("a/b.zip"), F.lit("a/b.MD"), F.lit("a.b/c")), (n % 4 + 1).cast("int"))
    return R.read(spark, sf_dir, "pages").select(
        "page_id", S.external_url("url").alias("href"), S.safe_decode(S.segment("url")).alias("decoded"), S.slug_norm("url").alias("norm"), S.relative_path(F.lit("a/b/c.md"), F.concat(F.lit("./../"), number, F.lit(".md"))).alias("near"), S.relative_path(F.lit("a/b/c.md"), far).alias("far"),
        S.date_datatype(date).alias("typed"), S.is_language_tag(F.when(n % 2 == 0, F.lit("de-AT")).otherwise(F.lit("d_e"))).alias("tag"), S.compact(F.concat(F.lit(V.PREFIXES["dcterms"] + "t"), number)).alias("short"), S.addresses_document(target, [".md"]).alias("addresses"),
    )
