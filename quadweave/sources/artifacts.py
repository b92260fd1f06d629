"""Reading graphs back from text, and the packed form of vectors."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import vocab as V

QUADS = "s string, p string, o_kind string, o_value string, o_datatype string"
_TOKEN = re.compile(
    r"\s*(?:#[^\n]*\n\s*)*(?:(?P<iri><[^<>\"{}|^`\\\x00-\x20]*>)|(?P<text>\"(?:[^\"\\\n]|\\.)*\")|(?P<directive>@prefix|@base)|@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)"
    r"|(?P<number>[+-]?(?:\d+\.\d+|\d+))|(?P<name>[A-Za-z][\w-]*)?:(?P<local>(?:[\w-]|%[0-9A-Fa-f]{2}|\.(?=[\w-]))*)|(?P<word>a|true|false)(?![\w:])|(?P<mark>[.;,])|(?P<end>$))"
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "b": "\b", "f": "\f", "'": "'"}


class GraphError(ValueError):
    """Text that is no graph of the supported kind."""


def parse_turtle(text: str) -> Iterator[tuple[str, str, str, str, str | None]]:
    """Triples of Turtle without blank nodes, collections and long strings; other constructs are refused."""
    at, prefixes, tokens = 0, {}, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GraphError(f"unexpected {text[at:].lstrip()[:20]!r}")
        at = m.end()
        if m["end"] is not None:
            break
        tokens.append(m)
    place = 0

    def take() -> re.Match:
        nonlocal place
        if place == len(tokens):
            raise GraphError("the text ends within a statement")
        place += 1
        return tokens[place - 1]

    def node(m: re.Match) -> str:
        if m["iri"]:
            return m["iri"][1:-1]
        if m["local"] is not None:
            if (m["name"] or "") not in prefixes:
                raise GraphError(f"unknown prefix {m['name']!r}")
            return prefixes[m["name"] or ""] + m["local"]
        raise GraphError(f"a node is expected, not {m[0].strip()!r}")

    def term() -> tuple[str, str, str | None]:
        nonlocal place
        m = take()
        if m["text"]:
            value = re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else _ESCAPES[e[3]], m["text"][1:-1])
            if place < len(tokens) and tokens[place]["dt"]:
                take()
                kind = node(take())
                return "literal", value, None if kind == V.XSD_STRING else kind
            if place < len(tokens) and tokens[place]["lang"]:
                raise GraphError("language tags are not supported")
            return "literal", value, None
        if m["number"]:
            return "literal", m["number"], V.iri("xsd:decimal") if "." in m["number"] else V.XSD_INTEGER
        if m["word"] in ("true", "false"):
            return "literal", m["word"], V.iri("xsd:boolean")
        return "iri", node(m), None

    while place < len(tokens):
        m = take()
        if m["directive"]:
            name, target = take(), take()
            prefixes[name["name"] or ""] = target["iri"][1:-1]
            take()
            continue
        s, mark = node(m), ";"
        while mark == ";":
            m = take()
            if m["mark"] == ".":
                break
            p, mark = (V.RDF_TYPE if m["word"] == "a" else node(m)), ","
            while mark == ",":
                yield (s, p, *term())
                mark = take()["mark"]
        if mark not in (".", ";"):
            raise GraphError("a statement does not end")


def parse_json_ld(text: str) -> Iterator[tuple[str, str, str, str, str | None]]:
    """Triples of flattened JSON-LD with a prefix context."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise GraphError(str(e)) from e
    context = data.get("@context", {})

    def expand(term: str) -> str:
        prefix, sep, local = term.partition(":")
        return context[prefix] + local if sep and isinstance(context.get(prefix), str) else term

    for item in data.get("@graph", []):
        for key, values in item.items():
            for v in values if isinstance(values, list) else [values]:
                if key == "@id":
                    continue
                if key == "@type":
                    yield item["@id"], V.RDF_TYPE, "iri", expand(v), None
                elif isinstance(v, dict) and "@id" in v:
                    yield item["@id"], expand(key), "iri", expand(v["@id"]), None
                else:
                    value, kind = (v["@value"], expand(v["@type"]) if "@type" in v else None) if isinstance(v, dict) else (v, None)
                    shown = value if isinstance(value, str) else json.dumps(value)
                    yield item["@id"], expand(key), "literal", shown, None if kind == V.XSD_STRING else kind


def read_graph(spark: SparkSession, path: str, form: str = "turtle") -> DataFrame:
    """Triples of one or more files, each parsed whole by one task."""
    parse = {"turtle": parse_turtle, "jsonld": parse_json_ld}[form]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(list(parse(text)), columns=["s", "p", "o_kind", "o_value", "o_datatype"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, QUADS)


# Fixed values of the vector file: magic number, version, place of the header.
MAGIC, VERSION, HEADER_AT = 0x444B4756, 2, 12


class VectorFileError(ValueError):
    """A vector file that can't be read."""


def pack_vectors(entries: Iterable[tuple[str, Iterable[float]]], model: str, dtype: str, source: str, language: str = V.UNDETERMINED) -> bytes:
    """Little-endian rows of unit length in order of id (by code unit), after a JSON header; a zero vector stays."""
    rows = sorted(((i, np.asarray(list(v), "<f4")) for i, v in entries), key=lambda x: x[0].encode("utf-16-be"))
    dims = rows[0][1].size if rows else 0
    if any(v.size != dims for _, v in rows):
        raise VectorFileError("vectors differ in their dimensions")
    header = json.dumps({"model": model, "dtype": dtype, "dims": dims, "count": len(rows), "ids": [i for i, _ in rows], "source": source, "language": language}, ensure_ascii=False, separators=(",", ":")).encode()
    m = np.stack([v for _, v in rows]).astype("float64") if rows else np.zeros((0, 0))
    length = np.sqrt((m**2).sum(axis=1, keepdims=True))
    return struct.pack("<III", MAGIC, VERSION, len(header)) + header + (m / np.where(length > 0, length, 1)).astype("<f4").tobytes()


def unpack_vectors(data: bytes) -> tuple[dict, np.ndarray]:
    """The header and the vectors, one row each; anything malformed is refused."""
    if len(data) < HEADER_AT:
        raise VectorFileError("the file is too short")
    magic, version, size = struct.unpack_from("<III", data)
    if magic != MAGIC:
        raise VectorFileError("no vector file")
    if version != VERSION:
        raise VectorFileError(f"version {version} is not supported")
    if HEADER_AT + size > len(data):
        raise VectorFileError("the header is cut off")
    try:
        header = json.loads(data[HEADER_AT : HEADER_AT + size])
    except ValueError as e:
        raise VectorFileError("the header is no JSON") from e
    if not isinstance(header, dict) or not isinstance(header.get("ids"), list) or not isinstance(header.get("dims"), int) or header.get("count") != len(header["ids"]):
        raise VectorFileError("the header is malformed")
    body = data[HEADER_AT + size :]
    if len(body) != header["count"] * header["dims"] * 4:
        raise VectorFileError("the vectors are cut off")
    return header, np.frombuffer(body, "<f4").reshape(header["count"], header["dims"])
