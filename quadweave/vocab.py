"""Namespaces, predicates and fixed tables."""

from __future__ import annotations

from pyspark.sql import types as T

NS = "urn:quadweave:ns#"
PREFIXES = {
    "dcterms": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "iirds": "http://iirds.tekom.de/iirds#",
    "iirdsSft": "http://iirds.tekom.de/iirds/domain/software#",
    "prov": "http://www.w3.org/ns/prov#",
    "qw": NS,
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "schema": "https://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def iri(curie: str) -> str:
    """A known prefix is expanded; anything else is taken as it is."""
    prefix, sep, local = curie.partition(":")
    return PREFIXES[prefix] + local if sep and prefix in PREFIXES else curie


RDF_TYPE, TITLE, DESCRIPTION, LANGUAGE = iri("rdf:type"), iri("dcterms:title"), iri("dcterms:description"), iri("dcterms:language")
REFERENCES, HAS_PART, SUBJECT, SOURCE = iri("dcterms:references"), iri("dcterms:hasPart"), iri("dcterms:subject"), iri("dcterms:source")
CREATOR, CREATED, MODIFIED = iri("dcterms:creator"), iri("dcterms:created"), iri("dcterms:modified")
PATH, CONTENT_HASH, LEVEL, ORDER = iri("qw:path"), iri("qw:contentHash"), iri("qw:level"), iri("qw:order")
BROKEN_LINK, BROKEN_SECTION = iri("qw:brokenLink"), iri("qw:brokenSection")
DOCUMENT, SECTION, CONCEPT = iri("qw:Document"), iri("qw:Section"), iri("skos:Concept")
APPLIES_TO, NOT_APPLIES_TO = iri("iirds:relates-to-product-variant"), iri("qw:notApplicableTo")
ASPECT, NOT_ASPECT, LIFECYCLE = iri("iirds:has-subject"), iri("qw:notAboutSubject"), iri("iirds:relates-to-product-lifecycle-phase")
TRANSLATION_OF, HAS_TRANSLATION = iri("schema:translationOfWork"), iri("schema:workTranslation")
TOPIC_TYPE, IN_SCHEME = iri("iirds:has-topic-type"), iri("skos:inScheme")
BROADER, NARROWER, RELATED = iri("skos:broader"), iri("skos:narrower"), iri("skos:related")
PRIMARY_TOPIC = iri("foaf:primaryTopic")
PREF_LABEL, ALT_LABEL = iri("skos:prefLabel"), iri("skos:altLabel")
XSD_STRING, XSD_INTEGER, XSD_DATE, XSD_DATETIME = iri("xsd:string"), iri("xsd:integer"), iri("xsd:date"), iri("xsd:dateTime")

QUADS = T.StructType().add("s", "string").add("p", "string").add("o_kind", "string").add("o_value", "string").add("o_datatype", "string")

#: Document coverage fields in report order.
COVERAGE = {
    "title": TITLE, "description": DESCRIPTION, "creator": CREATOR, "created": CREATED, "modified": MODIFIED, "subject": SUBJECT,
    "label": PRIMARY_TOPIC, "language": LANGUAGE, "type": TOPIC_TYPE, "applies-to": APPLIES_TO,
    "about-product-lifecycle": LIFECYCLE, "about-product-aspect": ASPECT,
}
SECTION_COVERAGE = {k: COVERAGE[k] for k in ("type", "applies-to", "about-product-lifecycle", "about-product-aspect", "subject")}
# fixed values: names of a published vocabulary
TOPIC_TYPES = {
    "task": iri("iirds:GenericTask"), "concept": iri("iirds:GenericConcept"), "reference": iri("iirds:GenericReference"),
    "learning": iri("iirds:GenericLearning"), "troubleshooting": iri("iirds:GenericTroubleshooting"), "form": iri("iirds:GenericForm"),
}
PAGE_TYPES = {"how-to": "task", "tutorial": "learning", "explanation": "concept", "reference": "reference", "troubleshooting": "troubleshooting"}
LIFECYCLE_IRIS = {
    "administration": iri("iirdsSft:Administration"), "customization": iri("iirdsSft:Customization"), "update": iri("iirdsSft:Update"),
    "deployment": iri("iirdsSft:Deployment"), "integration": iri("iirdsSft:Integration"), "deinstallation": iri("iirdsSft:Deinstallation"),
}
ASPECT_IRIS = {"architecture": iri("iirdsSft:Architecture"), "interface": iri("iirdsSft:Interface"), "system-requirement": iri("iirdsSft:SystemRequirement")}
UNDETERMINED = "und"
