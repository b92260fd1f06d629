"""Canonical text forms of triples: a row per subject, rendered by column expressions and ordered by code unit."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.scalars import code_unit_key

_SAFE = r"^[A-Za-z_][A-Za-z0-9_-]*$"
_ILLEGAL = r"[\x00-\x20<>\"{}|^`\\]"


class UncoveredPredicate(ValueError):
    """RDF/XML needs a prefix for every predicate."""


def shorten(iri: Column) -> Column:
    """``prefix:local`` where the local part is plainly safe, else ``<...>`` with illegal characters encoded."""
    clean = F.when(iri.rlike(_ILLEGAL), F.array_join(F.transform(F.split(iri, ""), lambda c: F.when(c.rlike(_ILLEGAL), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")).otherwise(iri)
    out = F.concat(F.lit("<"), clean, F.lit(">"))
    for prefix, ns in sorted(V.PREFIXES.items(), reverse=True):
        local = F.substr(iri, F.lit(len(ns) + 1))
        out = F.when(iri.startswith(ns) & local.rlike(_SAFE), F.concat(F.lit(prefix + ":"), local)).otherwise(out)
    return out


def _escaped(value: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, shown in pairs:
        value = F.replace(value, F.lit(plain), F.lit(shown))
    return value


def turtle_term(kind: Column, value: Column, datatype: Column) -> Column:
    quoted = F.concat(F.lit('"'), _escaped(value, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]), F.lit('"'))
    literal = F.when((datatype == V.XSD_INTEGER) & value.rlike(r"^-?\d+$"), value).when(datatype.isNotNull(), F.concat(quoted, F.lit("^^"), shorten(datatype))).otherwise(quoted)
    return F.when(kind == "iri", shorten(value)).otherwise(literal)


def turtle_blocks(quads: DataFrame) -> DataFrame:
    """``(s, block)``: each subject's statement, its predicates in order, types first, each with its objects in order.

    Triples meet once, by subject; one that comes twice is shown once.
    """
    # terms move as they are; keys to sort by and texts are made where they have met
    rows = quads.groupBy("s").agg(F.collect_list(F.struct("p", "o_kind", "o_value", "o_datatype")).alias("all"))

    def keyed(x: Column) -> Column:
        p, kind, value, datatype = x["p"], x["o_kind"], x["o_value"], x["o_datatype"]
        key = [(p != V.RDF_TYPE).alias("a"), code_unit_key(p).alias("p"), (kind != "iri").alias("k"), code_unit_key(value).alias("v"), F.coalesce(datatype, F.lit("")).alias("d")]
        return F.struct(*key, F.when(p == V.RDF_TYPE, F.lit("a")).otherwise(shorten(p)).alias("name"), turtle_term(kind, value, datatype).alias("t"))

    rows = rows.select("s", F.array_sort(F.transform("all", keyed)).alias("all"))

    def piece(x: Column, i: Column) -> Column:
        before = F.get("all", i - 1)
        lead = F.when(before["p"] == x["p"], F.when((before["k"] == x["k"]) & (before["v"] == x["v"]) & (before["d"] == x["d"]), F.lit("")).otherwise(F.concat(F.lit(", "), x["t"])))
        return F.coalesce(lead, F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(" ;\n  ")), x["name"], F.lit(" "), x["t"]))

    return rows.select("s", F.concat(shorten(F.col("s")), F.lit(" "), F.array_join(F.transform("all", piece), ""), F.lit(" .")).alias("block"))


def _stream(rows: DataFrame, column: str) -> Iterator[str]:
    """In subject order, a partition at a time."""
    for row in rows.orderBy(code_unit_key("s")).select(column).toLocalIterator():
        yield row[column]


def turtle(quads: DataFrame) -> Iterator[str]:
    """The lines of one canonical Turtle file: the prefixes, then a blank line and a block per subject."""
    for prefix, ns in sorted(V.PREFIXES.items()):
        yield f"@prefix {prefix}: <{ns}> .\n"
    for block in _stream(turtle_blocks(quads), "block"):
        yield f"\n{block}\n"


def rdf_xml(quads: DataFrame, prefixes: dict[str, str] | None = None) -> Iterator[str]:
    """The pieces of one RDF/XML file; predicates take the prefix of the longest namespace."""
    prefixes = prefixes or V.PREFIXES
    text = lambda c: _escaped(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])
    attribute = lambda c: _escaped(text(c), [('"', "&quot;")])
    p = F.col("p")
    name = F.lit(None).cast("string")
    for prefix, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        name = F.when(p.startswith(ns) & (F.length(p) > len(ns)), F.concat(F.lit(prefix + ":"), F.substr(p, F.lit(len(ns) + 1)))).otherwise(name)
    bare = quads.filter(name.isNull()).select("p").limit(1).collect()
    if bare:
        raise UncoveredPredicate(bare[0]["p"])
    v, d = F.col("o_value"), F.col("o_datatype")
    term = F.when(F.col("o_kind") == "iri", F.concat(F.lit("    <"), name, F.lit(' rdf:resource="'), attribute(v), F.lit('"/>')))
    term = term.otherwise(F.concat(F.lit("    <"), name, F.when(d.isNotNull() & (d != V.XSD_STRING), F.concat(F.lit(' rdf:datatype="'), attribute(d), F.lit('"'))).otherwise(F.lit("")), F.lit(">"), text(v), F.lit("</"), name, F.lit(">")))
    objects = F.struct(code_unit_key("p").alias("p"), (F.col("o_kind") != "iri").alias("k"), code_unit_key("o_value").alias("v"), F.coalesce("o_datatype", F.lit("")).alias("d"), term.alias("t"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(objects)), lambda x: x["t"]), "\n")
    rows = quads.groupBy("s").agg(lines.alias("lines")).select("s", F.concat(F.lit('  <rdf:Description rdf:about="'), attribute(F.col("s")), F.lit('">\n'), "lines", F.lit("\n  </rdf:Description>\n")).alias("block"))
    escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF\n' + "\n".join(f'  xmlns:{k}="{escape(ns)}"' for k, ns in sorted(prefixes.items())) + ">\n"
    yield from _stream(rows, "block")
    yield "</rdf:RDF>\n"


def _compact(iri: str) -> str:
    for prefix, ns in sorted(V.PREFIXES.items()):
        if iri.startswith(ns) and len(iri) > len(ns):
            return f"{prefix}:{iri[len(ns):]}"
    return iri


def json_ld(quads: DataFrame) -> Iterator[str]:
    """The pieces of one JSON-LD file with two-space indents; a single value stands without a list."""
    objects = F.struct(code_unit_key("p").alias("p"), (F.col("o_kind") != "iri").alias("k"), code_unit_key("o_value").alias("v"), F.coalesce("o_datatype", F.lit("")).alias("d"), F.struct("p", "o_kind", "o_value", "o_datatype").alias("t"))
    rows = quads.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(objects)), lambda x: x["t"]).alias("terms"))
    context = json.dumps(dict(sorted(V.PREFIXES.items())), indent=2, ensure_ascii=False).replace("\n", "\n  ")
    yield f'{{\n  "@context": {context},\n  "@graph": ['
    some = False
    for row in rows.orderBy(code_unit_key("s")).toLocalIterator():
        node: dict[str, object] = {"@id": row["s"]}
        values: dict[str, list] = {}
        for t in row["terms"]:
            if t["p"] == V.RDF_TYPE:
                values.setdefault("@type", []).append(_compact(t["o_value"]))
            elif t["o_kind"] == "iri":
                values.setdefault(_compact(t["p"]), []).append({"@id": t["o_value"]})
            elif t["o_datatype"] and t["o_datatype"] != V.XSD_STRING:
                values.setdefault(_compact(t["p"]), []).append({"@value": t["o_value"], "@type": _compact(t["o_datatype"])})
            else:
                values.setdefault(_compact(t["p"]), []).append(t["o_value"])
        if "@type" in values:
            node["@type"] = None
            values["@type"].sort()
        node |= {k: v[0] if len(v) == 1 else v for k, v in values.items()}
        yield ("," if some else "") + "\n    " + json.dumps(node, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        some = True
    yield "\n  ]\n}\n" if some else "]\n}\n"


FORMATS = {"turtle": turtle, "jsonld": json_ld, "rdfxml": rdf_xml}


def write(quads: DataFrame, path: str, form: str) -> None:
    """One file of a known form; ``quads`` itself is kept as Parquet, not as text."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(sorted(FORMATS))}")
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(FORMATS[form](quads))
