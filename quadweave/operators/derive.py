"""Rules from parsed documents to triples.

What a document says of itself is one select over the model: each rule gives an
array of triples, so a page is read once and not once for each rule.  Only
triples that several documents can say are deduplicated over the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import quads as Q
from .. import vocab as V
from ..functions import scalars as S
from ..store import cut
from .links import Route, resolve, route_language

SOURCES = ("frontmatter", "sections", "links", "tags", "images", "code", "provenance")
PROV, PROV_ENTITY, PROV_ACTIVITY = V.PREFIXES["prov"], V.iri("prov:Entity"), V.iri("prov:Activity")


@dataclass(frozen=True)
class Options:
    """``git`` is ``(path, created, modified, authors, renamed_from)``."""

    base: str | None = None
    sources: Sequence[str] = SOURCES
    routes: Sequence[Route] = ()
    qualified: bool = False
    tool: str = "quadweave"
    tool_version: str | None = None
    git: DataFrame | None = None
    head_time: str | None = None


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def first(*keys: str) -> Column:
    """The first of the keys that is set, as a string."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key("one", F.lit(k)), F.col("one")[k]).otherwise(out)
    return out


def listed(*keys: str) -> Column:
    """The first of the keys that is set, as strings; none for no key."""
    out = F.array().cast("array<string>")
    for k in reversed(keys):
        out = F.when(F.map_contains_key("many", F.lit(k)), F.col("many")[k]).otherwise(out)
    return out


_TRIPLES = "array<struct<s:string,p:string,o_kind:string,o_value:string,o_datatype:string>>"
_LABELS = "array<struct<kind:string,label:string>>"


def _each(values: Column, *forms: Callable[[Column], Column]) -> Column:
    """An array of what each form makes of each value."""
    return F.flatten(F.transform(values, lambda v: F.array(*(form(v) for form in forms))))


def _labels(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("label")))


def _rows(df: DataFrame, arrays: Sequence[Column], kind: str = _TRIPLES) -> DataFrame:
    """The items of all arrays; those with a null in a needed place are none."""
    out = df.select(F.inline(F.concat(*(F.coalesce(a.cast(kind), F.array().cast(kind)) for a in arrays))))
    return out.dropna(subset=["s", "p", "o_value"] if kind == _TRIPLES else ["label"])


class Rules:
    """The rules over one corpus.

    ``own`` are triples that no other document has, ``common`` those that others
    may have as well, both as arrays over a row of the model; ``labels`` are the
    names of nodes to mint, and ``parts`` triples that took a join.
    """

    def __init__(self, model: DataFrame, options: Options) -> None:
        self.o, self.base = options, S.base_iri(options.base)
        # parsed once
        self.model = cut(model.filter("error is null").withColumn("path", S.doc_path("path")).withColumn("doc", S.doc_iri("path", options.base)))
        self.prov = "provenance" in options.sources
        self.own: list[Column] = []
        self.common: list[Column] = []
        self.labels: list[Column] = []
        self.parts: list[DataFrame] = []
        self.minted: list[DataFrame] = []
        self.raws: list[Column] = []

    def concept_iri(self, label: Column) -> Column:
        return S.minted("concept", label, self.o.base)

    def agent(self, name: Column, kind: str) -> Column:
        return S.minted("agent/" + {"Person": "person", "Organization": "org", "SoftwareAgent": "software"}[kind], name, self.o.base)

    def variant(self, name: Column) -> Column:
        return S.minted("product", name, self.o.base)

    def linked(self, subject: Column, predicate: str, values: Column, form: Callable[[Column], Column]) -> Column:
        """Links to what the values become, each once."""
        return _each(F.array_distinct(F.transform(values, form)), lambda o: Q.link_of(subject, predicate, o))

    def qualified(self, about: Column, node: Column, agent: Column, role: str, kind: str) -> list[Column]:
        if not self.o.qualified:
            return []
        return [Q.link_of(about, f"{PROV}qualified{kind}", node), Q.link_of(node, V.RDF_TYPE, PROV + kind), Q.link_of(node, PROV + "agent", agent), Q.link_of(node, PROV + "hadRole", V.NS + role)]

    def authors(self, slugs: Column) -> Column:
        """What the document says of its authors, by their slugs."""
        doc = F.col("doc")
        agent = lambda x: F.concat(F.lit(self.base + "agent/person/"), S.segment(x))
        node = lambda x: F.concat(doc, F.lit("#prov.attribution."), x)
        return F.flatten(F.transform(slugs, lambda x: F.array(Q.link_of(doc, V.CREATOR, agent(x)), Q.link_of(doc, PROV + "wasAttributedTo", agent(x)), *self.qualified(doc, node(x), agent(x), "author", "Attribution"))))

    def associated(self, activity: Column, name: Column, role: str) -> Column:
        a = self.agent(name, "SoftwareAgent")
        node = F.concat(activity, F.lit(".assoc."), S.slug(name))
        return F.array(Q.link_of(activity, V.RDF_TYPE, PROV_ACTIVITY), Q.link_of(activity, PROV + "wasAssociatedWith", a), *self.qualified(activity, node, a, role, "Association"))

    def dated(self, value: Column, *predicates: str) -> Column:
        return F.array(*(Q.fact_of(F.col("doc"), p, value, F.coalesce(S.date_datatype(value), F.lit(V.XSD_STRING))) for p in predicates))

    # what every document has

    def identity(self) -> None:
        doc = F.col("doc")
        self.own.append(F.array(Q.fact_of(doc, V.PATH, F.col("path")), Q.fact_of(doc, V.CONTENT_HASH, F.col("content_hash")), Q.link_of(doc, V.RDF_TYPE, V.DOCUMENT)))
        if self.prov:
            # an old path of another document has it too
            (self.own if self.o.git is None else self.common).append(F.array(Q.link_of(doc, V.RDF_TYPE, PROV_ENTITY)))

    def frontmatter(self) -> None:
        doc = F.col("doc")
        language = F.coalesce(first("lang", "language"), route_language(F.col("path"), self.o.routes))
        self.own.append(F.array(Q.fact_of(doc, V.TITLE, F.coalesce(first("title"), F.nullif("first_h1", F.lit("")))), Q.fact_of(doc, V.DESCRIPTION, first("description")), Q.fact_of(doc, V.LANGUAGE, language)))
        named = listed("author", "authors")
        if self.prov:
            self.own.append(self.authors(F.array_distinct(F.transform(named, S.slug))))
            self.labels.append(_labels("Person", named))
        else:
            self.own.append(_each(F.array_distinct(named), lambda v: Q.fact_of(doc, V.CREATOR, v)))
        self.own.append(self.dated(first("date", "created"), V.CREATED, *[PROV + "generatedAtTime"] * self.prov))
        self.own.append(self.dated(first("updated", "lastmod", "modified"), V.MODIFIED))
        self.targets(listed("translation-of"), V.TRANSLATION_OF, V.HAS_TRANSLATION)
        self.hierarchy()
        self.own.append(self.typing(doc, self.harvested))
        self.labels += [_labels("ProductVariant", self.harvested(key)) for key in ("applies-to", "not-applicable-to")]

    def harvested(self, key: str) -> Column:
        """The block's value of a fact, or else the page's."""
        if key == "type":
            page = F.element_at(_map(V.PAGE_TYPES), first("type"))
            own = F.map_contains_key("one", F.lit("kg.type"))
            return F.filter(F.array(F.when(own, first("kg.type")).otherwise(page)), lambda x: x.isNotNull())
        page = {"applies-to": "applies-to", "not-applicable-to": "not-applicable-to", "concepts": "concepts", "revision-of": "supersedes"}.get(key)
        return listed(f"kg.{key}", *[page] * bool(page))

    def typing(self, subject: Column, get: Callable[[str], Column]) -> Column:
        """Topic type, applicability, life cycle and aspects, with the negatives."""
        out = []
        for key, predicate, table in (("type", V.TOPIC_TYPE, V.TOPIC_TYPES), ("about-product-lifecycle", V.LIFECYCLE, V.LIFECYCLE_IRIS), ("about-product-aspect", V.ASPECT, V.ASPECT_IRIS), ("not-about-product-aspect", V.NOT_ASPECT, V.ASPECT_IRIS)):
            out.append(self.linked(subject, predicate, get(key), lambda v: F.element_at(_map(table), v)))
        for key, predicate in (("applies-to", V.APPLIES_TO), ("not-applicable-to", V.NOT_APPLIES_TO)):
            out.append(self.linked(subject, predicate, get(key), self.variant))
        return F.concat(*out)

    def hierarchy(self) -> None:
        label = first("kg.label")
        topic = self.concept_iri(label)
        kinds = (("broader", V.BROADER), ("narrower", V.NARROWER), ("related-concepts", V.RELATED))
        self.own.append(F.array(Q.link_of(F.col("doc"), V.iri("foaf:primaryTopic"), topic)))
        about = [_each(listed("kg.alt-labels"), lambda v: Q.fact_of(F.lit(None).cast("string"), V.ALT_LABEL, v))]
        about += [_each(listed(f"kg.{key}"), lambda v: Q.link_of(F.lit(None).cast("string"), predicate, self.concept_iri(v))) for key, predicate in kinds]
        # the topic's IRI is made once for all that is said of it
        self.common.append(F.flatten(F.transform(F.array(topic), lambda t: F.transform(F.concat(*(a.cast(_TRIPLES) for a in about)), lambda x: x.withField("s", t)))))
        others = F.concat(*(listed(f"kg.{key}") for key, _ in kinds))
        self.labels += [_labels("Concept", F.array(label)), _labels("Concept", F.when(label.isNotNull(), others))]

    def tags(self) -> None:
        values = F.concat(listed("tags", "keywords"), self.harvested("concepts"))
        self.own.append(self.linked(F.col("doc"), V.SUBJECT, values, self.concept_iri))
        self.labels.append(_labels("Concept", values))

    def sections(self) -> None:
        doc = F.col("doc")

        def meta(x: Column) -> Callable[[str], Column]:
            return lambda key: F.coalesce(F.col("kg_sections")[x["slug"]][key], F.array().cast("array<string>"))

        def said(x: Column) -> Column:
            s = S.section_iri(doc, x["slug"])
            parent = F.when(x["parent"].isNull(), doc).otherwise(S.section_iri(doc, x["parent"]))
            plain = F.array(Q.fact_of(s, V.TITLE, x["title"]), Q.link_of(s, V.RDF_TYPE, V.SECTION), Q.fact_of(s, V.LEVEL, x["level"], V.XSD_INTEGER), Q.fact_of(s, V.ORDER, x["ord"], V.XSD_INTEGER), Q.link_of(parent, V.HAS_PART, s))
            more = F.when(F.map_contains_key("kg_sections", x["slug"]), F.concat(self.typing(s, meta(x)), self.linked(s, V.SUBJECT, meta(x)("concepts"), self.concept_iri)).cast(_TRIPLES)).otherwise(F.array().cast(_TRIPLES))
            return F.concat(plain.cast(_TRIPLES), more)

        lost = F.array_except(F.map_keys("kg_sections"), F.transform("sections", lambda x: x["slug"]))
        self.own += [F.flatten(F.transform("sections", said)), _each(lost, lambda v: Q.fact_of(doc, V.BROKEN_SECTION, v))]
        known = F.filter("sections", lambda x: F.map_contains_key("kg_sections", x["slug"]))
        for key, kind in (("concepts", "Concept"), ("applies-to", "ProductVariant"), ("not-applicable-to", "ProductVariant")):
            self.labels.append(_labels(kind, F.flatten(F.transform(known, lambda x: meta(x)(key)))))

    def links(self) -> None:
        found = resolve(self.model.select("path", F.explode("links").alias("raw")), self.model.select("path"), self.o.routes)
        anchors = self.model.select(F.col("path").alias("resolved"), F.explode(F.transform("sections", lambda x: x["slug"])).alias("anchor")).distinct().withColumn("known", F.lit(True))
        at = found.join(anchors, ["resolved", "anchor"], "left").withColumn("doc", S.doc_iri("path", self.o.base)).withColumn("target", S.doc_iri("resolved", self.o.base))
        inner = F.when(F.col("known"), S.section_iri("target", "anchor")).otherwise(F.col("target"))
        to = F.when(F.col("kind") == "external", F.col("url")).when(F.col("kind") == "internal", inner)
        broken = F.when(F.col("kind") == "broken", F.col("raw"))
        self.parts.append(_rows(at, [F.array(Q.link_of(F.col("doc"), V.REFERENCES, to), Q.fact_of(F.col("doc"), V.BROKEN_LINK, broken))]))

    def images(self) -> None:
        def image(v: Column) -> Column:
            here = S.doc_path(F.coalesce(S.relative_path("path", v), v))
            inner = F.concat(F.lit(self.base + "file/"), F.array_join(F.transform(F.split(here, "/"), S.segment), "/"))
            return F.when(S.has_scheme(v), v).otherwise(inner)

        self.own.append(self.linked(F.col("doc"), V.iri("schema:image"), F.col("images"), image))

    def code(self) -> None:
        self.own.append(_each(F.array_distinct("code"), lambda v: Q.fact_of(F.col("doc"), V.NS + "codeLanguage", v)))

    def targets(self, values: Column, predicate: str, inverse: str | None = None) -> None:
        """Edges to documents named by a path from the document or from the root, or by a URL; the inverse only within the corpus."""
        one = lambda v: F.struct(v.alias("raw"), F.lit(predicate).alias("p"), F.lit(inverse).cast("string").alias("inverse"))
        self.raws.append(F.transform(values, one))

    def resolved(self) -> None:
        """The triples of all ``targets``, looked up together."""
        rows = self.model.select("path", "doc", F.inline(F.concat(*self.raws))).distinct()
        known = self.model.select("path").distinct()
        outside = rows.filter(S.has_scheme("raw"))
        near = rows.filter(~S.has_scheme("raw")).withColumn("a", S.relative_path("path", F.col("raw"))).withColumn("b", S.doc_path("raw"))
        near = near.join(known.select(F.col("path").alias("a"), F.col("path").alias("hit_a")), "a", "left").join(known.select(F.col("path").alias("b"), F.col("path").alias("hit_b")), "b", "left")
        near = near.withColumn("hit", F.coalesce("hit_a", "hit_b")).withColumn("target", S.doc_iri("hit", self.o.base))
        doc, target = F.col("doc"), F.col("target")
        lost = F.when(F.col("hit").isNull(), F.col("raw"))
        self.parts += [_rows(outside, [F.array(Q.link_of(doc, F.col("p"), F.col("raw")))]), _rows(near, [F.array(Q.link_of(doc, F.col("p"), target), Q.fact_of(doc, V.BROKEN_LINK, lost), Q.link_of(target, F.col("inverse"), doc))])]

    def provenance(self) -> None:
        doc = F.col("doc")
        self.targets(listed("kg.derived-from"), PROV + "wasDerivedFrom")
        self.targets(self.harvested("revision-of"), PROV + "wasRevisionOf")
        if self.o.git is not None:
            self.history()
        by = first("generated-by")
        activity = F.concat("doc", F.lit("#prov.generation"))
        made = F.concat(F.array(Q.link_of(doc, PROV + "wasGeneratedBy", activity)), self.associated(activity, by, "generator"))
        self.own.append(F.when(by.isNotNull(), made))
        self.labels.append(_labels("SoftwareAgent", F.array(by)))
        self.common.append(F.flatten(F.transform("provenance", self.filled)))
        self.labels.append(_labels("SoftwareAgent", F.transform("provenance", lambda e: e["model"])))
        self.build()

    def filled(self, entry: Column) -> Column:
        label, fields = first("kg.label"), entry["fields"]
        activity = F.concat("doc", F.lit("#prov.kg-fill."), S.slug(entry["model"]))
        node = lambda f: F.concat(activity, F.lit(".field."), f)

        def sure(f: Column) -> Column:
            return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", S.half_up(entry["confidence"][f], 2)), "0+$", ""), r"\.$", "")

        each = _each(
            fields, lambda f: Q.link_of(activity, V.NS + "filledFieldEntry", node(f)), lambda f: Q.fact_of(node(f), V.NS + "filledField", f),
            lambda f: Q.fact_of(node(f), V.NS + "confidence", F.when(entry["confidence"][f].isNotNull(), sure(f)), V.iri("xsd:decimal")),
        )
        named = F.when(F.array_contains(fields, "label"), self.concept_iri(label))
        none = F.array().cast(_TRIPLES)
        return F.concat(*(F.coalesce(a.cast(_TRIPLES), none) for a in (self.associated(activity, entry["model"], "generator"), each, F.array(Q.link_of(activity, PROV + "generated", named)))))

    def history(self) -> None:
        """Git's facts; a page's own dates and authors come first."""
        g = self.model.select("path", "doc", "one", "many").join(self.o.git.select(F.col("path").alias("path"), F.col("created").alias("g_created"), F.col("modified").alias("g_modified"), F.col("authors").alias("g_authors"), "renamed_from"), "path")
        has = "frontmatter" in self.o.sources
        created = F.when(first("date", "created").isNull() | F.lit(not has), F.col("g_created"))
        modified = F.when(first("updated", "lastmod", "modified").isNull() | F.lit(not has), F.col("g_modified"))
        old = _each(F.col("renamed_from"), lambda v: Q.link_of(F.col("doc"), PROV + "wasRevisionOf", S.doc_iri(v, self.o.base)), lambda v: Q.link_of(S.doc_iri(v, self.o.base), V.RDF_TYPE, PROV_ENTITY))
        slugs = F.array_distinct(F.transform("g_authors", S.slug))
        if has:  # the others are among the page's own
            slugs = F.array_except(slugs, F.transform(listed("author", "authors"), S.slug))
        self.parts.append(_rows(g, [self.dated(created, V.CREATED, PROV + "generatedAtTime"), self.dated(modified, V.MODIFIED), self.authors(slugs), old]))
        self.minted.append(_rows(g, [_labels("Person", F.col("g_authors"))], _LABELS))

    def build(self) -> None:
        one = self.model.sparkSession.range(1)
        graph, activity, tool = F.lit(self.base + "graph"), F.lit(self.base + "activity/build"), F.lit(self.o.tool)
        self.own.append(F.array(Q.link_of(activity, PROV + "used", F.col("doc"))))
        about = [F.array(Q.link_of(graph, V.RDF_TYPE, PROV_ENTITY), Q.link_of(graph, PROV + "wasGeneratedBy", activity)), self.associated(activity, tool, "tool")]
        if self.o.tool_version:
            about.append(F.array(Q.fact_of(self.agent(tool, "SoftwareAgent"), V.NS + "version", F.lit(self.o.tool_version))))
        if self.o.head_time:
            about.append(F.array(Q.fact_of(activity, PROV + "endedAtTime", F.lit(self.o.head_time), V.XSD_DATETIME)))
        self.parts.append(_rows(one, about))
        self.minted.append(_rows(one, [_labels("SoftwareAgent", F.array(tool))], _LABELS))

    def nodes(self) -> DataFrame:
        """The triples of minted nodes, and of the concept scheme if there is a concept."""
        rows = [_rows(self.model, self.labels, _LABELS)] if self.labels else []
        if not rows and not self.minted:
            return self.model.sparkSession.createDataFrame([], V.QUADS)
        names = cut(Q.combine(*rows, *self.minted).distinct())
        label, scheme = F.col("label"), self.base + "scheme"
        out = [
            Q.facts(names.filter("kind = 'Concept'"), self.concept_iri(label), {V.PREF_LABEL: label}, {V.RDF_TYPE: V.CONCEPT, V.IN_SCHEME: scheme}),
            Q.facts(names.filter("kind = 'ProductVariant'"), self.variant(label), {V.TITLE: label}, {V.RDF_TYPE: V.iri("iirds:ProductVariant")}),
            *(Q.facts(names.filter(F.col("kind") == kind), self.agent(label, kind), {V.iri("foaf:name"): label}, {V.RDF_TYPE: PROV + kind}) for kind in ("Person", "SoftwareAgent")),
            Q.facts(names.filter("kind = 'Concept'").limit(1), F.lit(scheme), {V.TITLE: F.lit("Concepts")}, {V.RDF_TYPE: V.iri("skos:ConceptScheme")}),
        ]
        return Q.combine(*out)


def derive(model: DataFrame, options: Options | None = None) -> DataFrame:
    """The deduplicated triples of a parsed corpus; a concept scheme comes with its first concept."""
    options = options or Options()
    rules = Rules(model, options)
    rules.identity()
    for source in SOURCES:
        if source in options.sources:
            getattr(rules, source)()
    if rules.raws:
        rules.resolved()
    if rules.common:
        rules.parts.append(_rows(rules.model, rules.common))
    own, rest = _rows(rules.model, rules.own), Q.combine(rules.nodes(), *rules.parts)
    twice = rules.model.groupBy("path").count().filter("count > 1").limit(1).count()
    return Q.dedupe(own.unionByName(rest)) if twice else own.select(Q.COLUMNS).unionByName(Q.dedupe(rest))
