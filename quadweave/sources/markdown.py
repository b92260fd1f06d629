"""Markdown and MDX files as rows: frontmatter, heading tree, links, images and code languages.

No built-in reads Markdown, so each file is parsed by itself in an Arrow-fed
Python function; everything after that is DataFrame work on its columns.
"""

from __future__ import annotations

import datetime
import hashlib
import tomllib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``one`` and ``many`` hold page keys, and those of the ``kg`` block after ``kg.``, as a string and as strings.
MODEL = (
    "path string, present boolean, one map<string,string>, many map<string,array<string>>, kg_sections map<string,map<string,array<string>>>, "
    "provenance array<struct<model:string,fields:array<string>,confidence:map<string,double>>>, first_h1 string, "
    "sections array<struct<slug:string,title:string,level:int,ord:int,parent:string>>, links array<string>, images array<string>, code array<string>, content_hash string, error string"
)

_FENCE = regex.compile(r"^ {0,3}(?:(`{3,})(?=[^`]*$)|(~{3,}))[ \t]*([^\s`]*)")
_ATX = regex.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = regex.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_DEFINITION = regex.compile(r"^ {0,3}\[([^\]]+)\]:[ \t]*<?([^\s>]+)>?")
_CODE = regex.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", regex.S)
_TARGET = r"\(\s*(?:<([^>\n]*)>|((?:[^()\s\\]|\\.|\([^()\s]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)"
_INLINE = regex.compile(
    r"(?P<image>!)?\[(?P<text>(?:[^\[\]]|!?\[[^\[\]]*\](?:\([^()]*\))?)*)\](?:" + _TARGET.replace("([^>", "(?P<angle>[^>").replace("((?:[^()", "(?P<bare>(?:[^()") + r"|\[(?P<ref>[^\]]*)\])?"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*)>|(?<![\w\"'=(<])(?P<url>https?://[^\s<]+)"
)
_JSX = regex.compile(r"<([A-Za-z][\w.]*)((?:\s+[\w:-]+(?:=(?:\"[^\"]*\"|'[^']*'|\{[^}]*\}))?)*)\s*/?>")
_ATTRIBUTE = regex.compile(r"([\w:-]+)=(?:\"([^\"]*)\"|'([^']*)'|\{\s*(?:\"([^\"]*)\"|'([^']*)')\s*\})")


class FrontmatterError(ValueError):
    """A page's frontmatter can't be read."""


def _yaml(text: str) -> object:
    try:
        import yaml
    except ImportError as e:
        raise FrontmatterError("YAML frontmatter needs a YAML library") from e

    class Loader(yaml.SafeLoader):
        """Core-schema scalars: dates stay strings and only true and false are booleans."""

    drop = ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")
    Loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] not in drop] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", regex.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    try:
        return yaml.load(text, Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise FrontmatterError(str(e).split("\n")[0]) from e


def frontmatter(content: str) -> tuple[dict, bool, str]:
    """The keys, whether there is a block, and the body after it."""
    for fence, read in (("---", _yaml), ("+++", tomllib.loads)):
        m = regex.match(regex.escape(fence) + r"[ \t]*\r?\n(.*?)(?:^|(?<=\n))" + regex.escape(fence) + r"[ \t]*(?:\r?\n|$)", content, regex.S)
        if m:
            try:
                data = read(m[1])
            except tomllib.TOMLDecodeError as e:
                raise FrontmatterError(str(e)) from e
            return (data if isinstance(data, dict) else {}), True, content[m.end() :]
    return {}, False, content


def as_string(value: object) -> str | None:
    """Non-empty strings, numbers and times; booleans and the rest are nothing."""
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        return value or None
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, int | float):
        return str(value)
    if isinstance(value, datetime.datetime):
        value = value if value.tzinfo else value.replace(tzinfo=datetime.UTC)
        return value.astimezone(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return value.isoformat() if isinstance(value, datetime.date) else None


def as_strings(value: object) -> list[str]:
    """One string or a list's usable items; a bare number is none."""
    if isinstance(value, str):
        return [value] if value else []
    return [s for s in map(as_string, value) if s is not None] if isinstance(value, list) else []


class Slugger:
    """Heading slugs of one document; a repeated one gets ``-1``, ``-2``..."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def slug(self, title: str) -> str:
        base = out = slug(title)
        while out in self.seen:
            self.seen[base] += 1
            out = f"{base}-{self.seen[base]}"
        self.seen[out] = 0
        return out


def slug(title: str) -> str:
    return regex.sub(r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", "", title.lower()).replace(" ", "-")


def plain(text: str) -> str:
    """Inline markup as the text it shows."""
    spans: list[str] = []
    text = _CODE.sub(lambda m: spans.append(m[2].strip()) or f"\0{len(spans) - 1}\0", text)
    while (new := _INLINE.sub(lambda m: m["text"] if m["text"] is not None and (m["bare"] is not None or m["angle"] is not None or m["ref"] is not None) else m["auto"] or m["url"] or m[0], text)) != text:
        text = new
    text = regex.sub(r"</?[A-Za-z][^>]*>", "", text)
    text = regex.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = regex.sub(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", text)
    text = regex.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)
    return regex.sub("\0(\\d+)\0", lambda m: spans[int(m[1])], text).strip()


def _inline(text: str, definitions: dict[str, str], links: list[str], images: list[str]) -> None:
    for m in _INLINE.finditer(text):
        if m["auto"] or m["url"]:
            links.append(m["auto"] or regex.sub(r"[?!.,:*_~'\")]+$", "", m["url"]))
            continue
        target = m["angle"] if m["angle"] is not None else m["bare"]
        if target is None:
            target = definitions.get((m["ref"] or m["text"]).strip().lower())
        else:
            target = regex.sub(r"\\([!-/:-@\[-`{-~])", r"\1", target)
        if target is not None:
            (images if m["image"] else links).append(target)
        if not m["image"]:
            _inline(m["text"], definitions, links, images)


def analyse(path: str, content: str) -> tuple:
    """A file's row, as ``MODEL`` has it."""
    data, present, body = frontmatter(content)
    kg = data.get("kg") if isinstance(data.get("kg"), dict) else {}
    keyed = {k: v for k, v in data.items() if k != "kg" and v is not None} | {f"kg.{k}": v for k, v in kg.items() if v is not None}
    per_section = kg.get("sections") if isinstance(kg.get("sections"), dict) else {}
    meta = {str(k): {str(a): ([s] if a == "type" and (s := as_string(b)) else as_strings(b)) for a, b in v.items() if b is not None} if isinstance(v, dict) else {} for k, v in per_section.items()}
    entries = []
    for e in kg.get("provenance") if isinstance(kg.get("provenance"), list) else []:
        if isinstance(e, dict) and (model := as_string(e.get("generated-by"))):
            sure = e.get("confidence") if isinstance(e.get("confidence"), dict) else {}
            entries.append((model, as_strings(e.get("fields")), {str(k): float(v) for k, v in sure.items() if isinstance(v, int | float) and not isinstance(v, bool)}))

    lines, fence, text, heads, code = regex.split(r"\r?\n", body), "", [], [], set()
    definitions: dict[str, str] = {}
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            if m and (m[1] or m[2]).startswith(fence) and not line.strip(" \t" + fence[0]):
                fence = ""
            line = ""
        elif m:
            fence, line = m[1] or m[2], ""
            if m[3]:
                code.add(m[3])
        elif (m := _ATX.match(line)) is not None:
            heads.append((len(m[1]), m[2] or ""))
        elif (m := _SETEXT.match(line)) and text and text[-1].strip() and not _ATX.match(text[-1]) and not regex.match(r" {0,3}(?:[-*+>|]|\d+[.)])", text[-1]):
            heads.append((1 if m[1][0] == "=" else 2, text[-1].strip()))
            line = ""
        elif m := _DEFINITION.match(line):
            definitions.setdefault(m[1].strip().lower(), m[2])
            line = ""
        text.append(line)

    slugger, stack, children, sections, first_h1 = Slugger(), [], {}, [], None
    for level, raw in heads:
        title = plain(raw)
        if level == 1 and first_h1 is None:
            first_h1 = title
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][1] if stack else None
        children[parent] = children.get(parent, 0) + 1
        here = slugger.slug(title)
        sections.append((here, title, level, children[parent], parent))
        stack.append((level, here))

    links: list[str] = []
    images: list[str] = []
    shown = _CODE.sub(" ", "\n".join(text))
    if path.lower().endswith(".mdx"):
        for m in _JSX.finditer(shown):
            for a in _ATTRIBUTE.finditer(m[2]):
                value = next((v for v in a.groups()[1:] if v is not None), "")
                if a[1] == "href":
                    links.append(value)
                elif a[1] == "src" and m[1].lower() in ("img", "image"):
                    images.append(value)
        shown = _JSX.sub(" ", shown)
    _inline(shown, definitions, links, images)
    return (
        path, present, {k: as_string(v) for k, v in keyed.items()}, {k: as_strings(v) for k, v in keyed.items()}, meta, entries, first_h1, sections,
        links, images, sorted(code), hashlib.sha256(content.encode()).hexdigest(), None,
    )


def parse(files: DataFrame) -> DataFrame:
    """``MODEL`` rows of ``files(path, content)``; a file that can't be read has an ``error`` and nothing else."""
    names = [x.strip().split(" ")[0] for x in regex.split(r", (?![^<]*>)", MODEL)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append(analyse(path, content or ""))
                except FrontmatterError as e:
                    rows.append((path, True, *[None] * 10, str(e)))
            yield pd.DataFrame(rows, columns=names)

    # a page takes milliseconds, and a small table can make many: pages are dealt out, not parsed where they lie
    spark = files.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", F.col("content").cast("string").alias("content")).repartition(n, "path").mapInPandas(run, MODEL)


def discover(spark: SparkSession, root: str, pattern: str = r"\.mdx?$", exclude: str | None = r"(^|/)node_modules/") -> DataFrame:
    """``(path, content)`` of the files under ``root`` whose path below it fits; no dotfiles; ordered by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + regex.escape("/" + root.split(":", 1)[-1].strip("/")) + "/", "")
    rows = found.select(at.alias("path"), F.decode("content", "UTF-8").alias("content")).filter(F.col("path").rlike(pattern) & ~F.col("path").rlike(r"(^|/)\."))
    return (rows.filter(~F.col("path").rlike(exclude)) if exclude else rows).orderBy("path")
