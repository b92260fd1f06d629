"""Identity, path, link and text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import PREFIXES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_iri(base: str | None) -> str:
    base = base or "urn:quadweave:"
    return base if base.endswith(("/", ":")) else base + "/"


def doc_path(path: Column | str) -> Column:
    return F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def segment(text: Column | str) -> Column:
    """Strict percent-encoding; form encoding's ``+``, ``*`` and ``%7E`` are put right."""
    out = F.url_encode(_c(text))
    for wrong, right in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def doc_iri(path: Column | str, base: str | None = None) -> Column:
    parts = F.transform(F.split(doc_path(path), "/"), segment)
    return F.concat(F.lit(base_iri(base) + "doc/"), F.array_join(parts, "/"))


def section_iri(doc: Column | str, slug: Column | str) -> Column:
    return F.concat(_c(doc), F.lit("#"), _c(slug))


def slug(text: Column | str) -> Column:
    """Lower case; letters, digits, marks, ``_``, ``-`` and spaces stay, spaces as ``-``."""
    return F.replace(F.regexp_replace(F.lower(F.trim(_c(text))), r"[^\p{L}\p{N}\p{M}_\- ]", ""), F.lit(" "), F.lit("-"))


def minted(kind: str, label: Column | str, base: str | None = None) -> Column:
    """A concept, product or agent IRI; each kind has a path segment of its own."""
    return F.concat(F.lit(f"{base_iri(base)}{kind}/"), segment(slug(label)))


def safe_decode(text: Column | str) -> Column:
    text = _c(text)
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def has_scheme(text: Column | str) -> Column:
    return _c(text).rlike(r"^(?i)[a-z][a-z0-9+.-]*:")


def addresses_document(target: Column | str, extensions: list[str]) -> Column:
    """Whether the last path part has no extension or a document's."""
    if not extensions:
        return F.lit(True)
    ext = F.lower(F.regexp_extract(_c(target), r"(\.[^./]+)$", 1))
    return (ext == "") | ext.isin([e.lower() for e in extensions])


def is_language_tag(text: Column | str) -> Column:
    return _c(text).rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")


def slug_norm(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(text)), "[-_]", "")


def fragment_split(target: Column | str) -> tuple[Column, Column]:
    """Path and anchor, the anchor null without ``#``."""
    t = _c(target)
    return F.substring_index(t, "#", 1), F.when(F.instr(t, "#") > 0, F.regexp_extract(t, r"^[^#]*#(.*)$", 1))


def relative_path(doc: Column | str, target: Column | str) -> Column:
    """``target`` from the folder of ``doc``; null where it leaves the root."""
    folder = F.split(F.regexp_replace(_c(doc), r"[^/]*$", ""), "/")
    parts = F.filter(F.concat(folder, F.split(_c(target), "/")), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))
    up = lambda a, p: F.when(p == "..", F.struct(F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["ok"] & (F.size(a["at"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(a["at"], F.array(p)).alias("at"), a["ok"].alias("ok")))
    ends = F.array(F.aggregate(parts, start, up))  # a lambda's argument is worked out once
    return F.transform(ends, lambda end: F.when(end["ok"], F.array_join(end["at"], "/")))[0]


def date_datatype(text: Column | str) -> Column:
    """The XSD datatype of a lexical date or timestamp, else null."""
    t = _c(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(PREFIXES["xsd"] + "date")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"), F.lit(PREFIXES["xsd"] + "dateTime"))


def expand(term: Column | str) -> Column:
    t = _c(term)
    out = t
    for prefix, ns in PREFIXES.items():
        out = F.when(t.startswith(prefix + ":"), F.concat(F.lit(ns), F.substr(t, F.lit(len(prefix) + 2)))).otherwise(out)
    return out


def compact(iri: Column | str) -> Column:
    """By the longest namespace that fits."""
    t = _c(iri)
    out = t
    for prefix, ns in sorted(PREFIXES.items(), key=lambda x: len(x[1])):
        out = F.when(t.startswith(ns) & (F.length(t) > len(ns)), F.concat(F.lit(prefix + ":"), F.substr(t, F.lit(len(ns) + 1)))).otherwise(out)
    return out


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves up, as ``floor(x * 10^digits + 0.5) / 10^digits``."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def code_unit_key(text: Column | str) -> Column:
    """Orders by UTF-16 code unit."""
    return F.encode(_c(text), "UTF-16BE")


def external_url(url: Column | str) -> Column:
    """Scheme and host in lower case, the scheme's own port dropped, an empty path as ``/``."""
    u = F.trim(_c(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(u, r"^[^:]+://([^/?#]*)", 1))
    for s, port in (("http", "80"), ("https", "443"), ("ftp", "21")):
        host = F.when(scheme == s, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    rest = F.regexp_extract(u, r"^[^:]+://[^/?#]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(scheme, F.lit("://"), host, rest)).otherwise(u)


def label_join(labels: Column) -> Column:
    """Trimmed labels, one spelling (the first) per case-folded form, in order and joined by spaces; null if none."""
    trimmed = F.filter(F.transform(labels, F.trim), lambda x: x != "")
    lowered = F.transform(trimmed, F.lower)
    first = F.filter(trimmed, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.when(F.size(first) > 0, F.array_join(F.array_sort(first), " "))
