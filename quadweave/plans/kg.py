"""Queries of the knowledge-graph operators over the relational tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import quads as Q
from .. import vocab as V
from ..functions import scalars as S
from ..emit import text
from ..operators import check, derive, graph, retrieve, scope, search, stats
from ..sources import markdown
from ..sources import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lit(table: str, s: str, p: str, value: str, where: str = "true") -> str:
    return f"select {s} as s, '{p}' as p, 'literal' as o_kind, cast({value} as varchar) as o_value from {table} where {where} and {value} is not null"


def _iri(table: str, s: str, p: str, value: str, where: str = "true") -> str:
    return f"select {s} as s, '{p}' as p, 'iri' as o_kind, {value} as o_value from {table} where {where}"


def n(kind: str, key: str) -> str:
    return f"'urn:kg:{kind}/' || {key}"


_TRANS = "(select d.doc_id, max(e.doc_id) as of_id from documents d join documents e on e.lang = 'en' and e.doc_id < d.doc_id where d.lang <> 'en' group by d.doc_id)"
_DOC = " union all ".join([
    _iri("documents", n("doc", "doc_id"), V.RDF_TYPE, f"'{V.DOCUMENT}'"),
    _lit("documents", n("doc", "doc_id"), V.LANGUAGE, "lang"),
    _lit("documents", n("doc", "doc_id"), V.SOURCE, "source"),
    _lit("documents", n("doc", "doc_id"), V.CONTENT_HASH, "sha256(text)"),
    _lit("documents", n("doc", "doc_id"), V.TITLE, "nullif(split_part(text, chr(10), 1), '')"),
    _iri("labels", n("doc", "doc_id"), V.APPLIES_TO, "case when quality = 1 then 'urn:kg:variant/high' else 'urn:kg:variant/low' end"),
    _iri("labels", n("doc", "doc_id"), V.NOT_APPLIES_TO, "'urn:kg:variant/high'", "toxic = 1"),
    _iri(_TRANS, n("doc", "doc_id"), V.TRANSLATION_OF, n("doc", "of_id")),
    _iri(_TRANS, n("doc", "of_id"), V.HAS_TRANSLATION, n("doc", "doc_id")),
])
_STAR = " union all ".join([
    _iri("region", n("region", "r_regionkey"), V.RDF_TYPE, f"'{V.NS}Region'"), _lit("region", n("region", "r_regionkey"), V.TITLE, "r_name"),
    _iri("nation", n("nation", "n_nationkey"), V.RDF_TYPE, f"'{V.NS}Nation'"), _lit("nation", n("nation", "n_nationkey"), V.TITLE, "n_name"),
    _iri("nation", n("nation", "n_nationkey"), V.REFERENCES, n("region", "n_regionkey")),
    _iri("customer", n("customer", "c_custkey"), V.RDF_TYPE, f"'{V.NS}Customer'"), _lit("customer", n("customer", "c_custkey"), V.TITLE, "c_name"), _lit("customer", n("customer", "c_custkey"), V.SUBJECT, "c_mktsegment"),
    _iri("customer", n("customer", "c_custkey"), V.REFERENCES, n("nation", "c_nationkey")),
    _iri("supplier", n("supplier", "s_suppkey"), V.RDF_TYPE, f"'{V.NS}Supplier'"), _lit("supplier", n("supplier", "s_suppkey"), V.TITLE, "s_name"),
    _iri("supplier", n("supplier", "s_suppkey"), V.REFERENCES, n("nation", "s_nationkey")),
    _iri("part", n("part", "p_partkey"), V.RDF_TYPE, f"'{V.NS}Part'"), _lit("part", n("part", "p_partkey"), V.TITLE, "p_name"), _lit("part", n("part", "p_partkey"), V.SUBJECT, "p_type"),
    _iri("orders", n("order", "o_orderkey"), V.RDF_TYPE, f"'{V.NS}Order'"), _lit("orders", n("order", "o_orderkey"), V.SUBJECT, "o_orderpriority"),
    _iri("orders", n("order", "o_orderkey"), V.SOURCE, n("customer", "o_custkey")),
    _iri("(select distinct l_orderkey, l_partkey from lineitem)", n("order", "l_orderkey"), V.REFERENCES, n("part", "l_partkey")),
])
_UP = "select p_partkey as k, p_partkey // 4 as up from part where p_partkey > 0"
_CLOSE = (
    f"with recursive u as ({_UP}), e as (select k as child, up as parent from u union select up, k from u where k % 97 = 0), "
    "c(child, parent) as (select child, parent from e union select c.child, e.parent from c join e on c.parent = e.child)"
)


@query(f"select s, p, o_kind, o_value from ({_DOC}) group by all")
def q_quads_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dedupe(R.documents(spark, sf_dir)).select("s", "p", "o_kind", "o_value")


@query(f"select s, p, o_kind, o_value from ({_STAR}) group by all")
def q_quads_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dedupe(R.star(spark, sf_dir)).select("s", "p", "o_kind", "o_value")


@query(f"select s, p, o_kind, o_value from ({_DOC}) where p = '{V.LANGUAGE}' and o_value = 'de'")
def q_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ordered(Q.match(R.documents(spark, sf_dir), p="dcterms:language", o="de")).select("s", "p", "o_kind", "o_value")


@query(f"select distinct s as iri from ({_STAR}) where p = '{V.RDF_TYPE}' and o_value = '{V.NS}Customer'")
def q_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.instances(R.star(spark, sf_dir), "qw:Customer")


@query(f"select s, min(o_value) as title from ({_STAR}) where p = '{V.TITLE}' group by s")
def q_first_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_literal(R.star(spark, sf_dir), V.TITLE, "title")


@query(f"with q as ({_STAR}) select distinct 'out' as dir, p, o_value as iri from q where s = 'urn:kg:nation/3' and o_kind = 'iri' and p <> '{V.RDF_TYPE}' union select distinct 'in', p, s from q where o_value = 'urn:kg:nation/3' and o_kind = 'iri' and p <> '{V.RDF_TYPE}'")
def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.neighbours(R.star(spark, sf_dir), "urn:kg:nation/3")


@query(f"select count(*) as triples, count(*) filter (where p = '{V.RDF_TYPE}' and o_value = '{V.DOCUMENT}') as documents, count(*) filter (where p = '{V.RDF_TYPE}' and o_value = '{V.SECTION}') as sections, count(*) filter (where p = '{V.RDF_TYPE}' and o_value = '{V.CONCEPT}') as concepts, count(*) filter (where p = '{V.REFERENCES}') as \"references\" from ({_DOC})")
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(R.documents(spark, sf_dir))


_DEGREE = f"select {n('order', 'o_orderkey')} as iri, coalesce(c, 0) as degree from orders left join (select l_orderkey, count(distinct l_partkey) as c from lineitem group by 1) on l_orderkey = o_orderkey"


@query(f"select iri, cast(degree as bigint) as degree from ({_DEGREE})")
def q_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degrees(R.star(spark, sf_dir), "qw:Order")


@query(f"select iri from ({_DEGREE}) where degree = 0")
def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.orphans(R.star(spark, sf_dir), "qw:Order")


@query(f"select iri, cast(degree as bigint) as degree from ({_DEGREE}) where degree > 0 order by degree desc, iri limit 5")
def q_most_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_connected(R.star(spark, sf_dir), "qw:Order")


_FIELDS = V.COVERAGE
_F_SQL = "(values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_FIELDS.items())) + ") f(ord, field, p)"


@query(f"with q as ({_DOC}), t as (select count(*) as total from documents) select field, covered, total, floor(covered * 100.0 / total * 10 + 0.5) / 10 as pct from (select f.field, count(distinct q.s) as covered from {_F_SQL} left join q on q.p = f.p group by 1), t")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage(R.documents(spark, sf_dir), fields=_FIELDS).select("field", "covered", "total", "pct")


@query(f"with q as ({_DOC}), t as (select lang, count(*) as total from documents group by 1), c as (select d.lang, q.p, count(distinct q.s) as n from q join documents d on q.s = {n('doc', 'd.doc_id')} group by 1, 2) select t.lang as \"group\", f.field, coalesce(c.n, 0) as covered, t.total, floor(coalesce(c.n, 0) * 100.0 / t.total * 10 + 0.5) / 10 as pct from t cross join {_F_SQL} left join c on c.lang = t.lang and c.p = f.p")
def q_language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.documents(spark, sf_dir)
    return stats.coverage(q, fields=_FIELDS, by=stats.languages(q)).select("group", "field", "covered", "total", "pct")


@query(f"with q as ({_DOC}), t as (select count(*) as total from documents) select field, covered, cast(90.0 as double) as threshold from (select f.field, count(distinct q.s) as covered from {_F_SQL} left join q on q.p = f.p group by 1), t where covered * 100.0 / total < 90")
def q_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.below(stats.coverage(R.documents(spark, sf_dir), fields=_FIELDS), uniform=90).select("field", "covered", "threshold")


@query(f"with t as (select of_id, d.lang from {_TRANS} x join documents d using (doc_id)) select {n('doc', 'e.doc_id')} as iri, l.lang as language from documents e cross join (select distinct lang from documents where lang <> 'en') l where e.lang = 'en' and not exists (select 1 from t where t.of_id = e.doc_id and t.lang = l.lang)")
def q_untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.untranslated(R.documents(spark, sf_dir))


@query(f"select {n('doc', 'd.doc_id')} as iri, case when toxic = 1 then 'variant-negative' when quality = 0 then 'variant-not-listed' else 'language' end as rule from documents d left join labels l using (doc_id) where coalesce(toxic, 0) = 1 or quality = 0 or lang <> 'en'")
def q_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.documents(spark, sf_dir)
    return scope.exclusions(q, variant=scope.resolve_variant(q, "high"), language="en")


def _bfs(seed: str, moves: str, depth: int) -> str:
    return f"with recursive e as (select s, o_value as o from ({_STAR}) where o_kind = 'iri' and p <> '{V.RDF_TYPE}'), m as ({moves}), r(iri, depth) as (select '{seed}', 0 union select m.b, r.depth + 1 from r join m on m.a = r.iri where r.depth < {depth}) select iri, min(depth) as depth from r group by iri"


@query(f"select iri, cast(depth as int) as depth from ({_bfs('urn:kg:customer/7', 'select s as a, o as b from e union select o, s from e', 2)})")
def q_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = spark.createDataFrame([("urn:kg:customer/7",)], "iri string")
    return graph.traverse(R.star(spark, sf_dir), seed, depth=2, direction="both").nodes.select("iri", "depth")


@query(f"select distinct s as iri from ({_STAR}) where p = '{V.REFERENCES}' and o_value = 'urn:kg:part/5'")
def q_reverse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_references(R.star(spark, sf_dir), "urn:kg:part/5").select("iri")


@query(f"select iri, cast(depth as int) as depth from ({_bfs('urn:kg:region/1', 'select o as a, s as b from e', 3)}) where depth > 0")
def q_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(R.star(spark, sf_dir), "urn:kg:region/1").select("iri", "depth")


@query(f"{_CLOSE} select {n('concept', 'child')} as child, {n('concept', 'parent')} as parent from c")
def q_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(graph.broader_edges(R.taxonomy(spark, sf_dir)))


@query(f"{_CLOSE} select {n('concept', 'a.child')} as iri, min({n('concept', 'a.parent')}) as component from c a join c b on a.child = b.parent and a.parent = b.child group by 1")
def q_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(graph.broader_edges(R.taxonomy(spark, sf_dir)))


_PAIR = f"least({n('concept', 'x')}, {n('concept', 'y')}) as a, greatest({n('concept', 'x')}, {n('concept', 'y')}) as b"


@query(
    f"{_CLOSE}, r as (select distinct {_PAIR} from (select p_partkey as x, p_partkey // 16 as y from part where p_partkey % 5 = 0 union all select p_partkey, p_partkey * 3 + 1 from part where p_partkey % 7 = 0) where x <> y), "
    f"far as (select distinct {_PAIR} from (select child as x, parent as y from c)), near as (select distinct {_PAIR} from (select child as x, parent as y from e)) "
    "select a, b from r where (a, b) in (select a, b from far) and (a, b) not in (select a, b from near)"
)
def q_related_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related_conflicts(R.taxonomy(spark, sf_dir))


_SHAPE = check.Shape(target_class=V.DOCUMENT, closed=True, ignored=(V.RDF_TYPE, V.TRANSLATION_OF, V.HAS_TRANSLATION, V.SOURCE), properties=(
    check.Property(V.TITLE, min_count=1, max_count=1), check.Property(V.LANGUAGE, min_count=1, one_of=("en", "fr", "de")),
    check.Property(V.CONTENT_HASH, pattern="^[0-7]"), check.Property(V.APPLIES_TO, iri_only=True, disjoint=V.NOT_APPLIES_TO), check.Property(V.NOT_APPLIES_TO, cls=V.iri("iirds:ProductVariant")),
))
_SHAPE_SQL = " union all ".join([
    f"select 'violation' as severity, 'minCount' as message, {n('doc', 'doc_id')} as focus, '{V.TITLE}' as path from documents where nullif(split_part(text, chr(10), 1), '') is null",
    f"select 'violation', 'in', {n('doc', 'doc_id')}, '{V.LANGUAGE}' from documents where lang not in ('en', 'fr', 'de')",
    f"select 'violation', 'pattern', {n('doc', 'doc_id')}, '{V.CONTENT_HASH}' from documents where sha256(text)[1] > '7'",
    f"select 'violation', 'disjoint', {n('doc', 'doc_id')}, '{V.APPLIES_TO}' from labels where quality = 1 and toxic = 1",
    f"select 'violation', 'class', {n('doc', 'doc_id')}, '{V.NOT_APPLIES_TO}' from labels where toxic = 1",
])


@query(_SHAPE_SQL)
def q_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.validate(R.documents(spark, sf_dir), [_SHAPE])


@query(f"select severity, count(*) as n from ({_SHAPE_SQL}) group by 1")
def q_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.validate(R.documents(spark, sf_dir), [_SHAPE]).groupBy("severity").agg(F.count("*").alias("n"))


_BACK = f"(select distinct s, o_value as o from ({_DOC}) where o_kind = 'iri' and p <> '{V.RDF_TYPE}')"
_FOCUS = f"(select {n('doc', 'doc_id')} as focus from labels where quality = 1 and toxic = 1)"


@query(f"with b as {_BACK}, f as {_FOCUS}, z as (select focus, focus as doc from f union select focus, s from f join b on b.o = focus union select focus, c.s from f join b on b.o = focus join b c on c.o = b.s) select focus, doc from z where doc in (select {n('doc', 'doc_id')} from documents)")
def q_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.documents(spark, sf_dir)
    conflicts = check.validate(q, [check.Shape(target_class=V.DOCUMENT, properties=(check.Property(V.APPLIES_TO, disjoint=V.NOT_APPLIES_TO),))])
    return check.blame(q, conflicts)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search entries of documents: title, own text and language."""
    docs = R.read(spark, sf_dir, "documents")
    return docs.select(R.node("doc", "doc_id").alias("id"), F.lit("Document").alias("type"), F.substring_index("text", "\n", 1).alias("title"), F.col("text"), F.col("lang").alias("language"))


_TERMS = ("the", "stupid", "que")
_BM25 = (
    "with w as (select 'urn:kg:doc/' || doc_id as id, f.field, f.boost, list_filter(regexp_split_to_array(lower(f.body), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as words from documents, lateral (values ('title', 3.0, split_part(text, chr(10), 1)), ('text', 1.0, text)) f(field, boost, body)), "
    "s as (select id, field, boost, len(words) as n, words from w), a as (select field, count(*) as docs, avg(n) as avg_n from s group by 1), "
    f"t as (select id, field, boost, n, q.term, len(list_filter(words, lambda x: x = q.term)) as tf from s, (values {', '.join(f"('{t}')" for t in _TERMS)}) q(term)), "
    "h as (select * from t where tf > 0), d as (select field, term, count(*) as df from h group by 1, 2), "
    "r as (select id, sum(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))) as score from h join d using (field, term) join a using (field) group by 1) "
)


@query(_BM25 + "select id, round(score, 6) as score from r order by round(score, 9) desc, id limit 10")
def q_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(entries(spark, sf_dir), " ".join(_TERMS)).select("id", F.round("score", 6).alias("score"))


_VEC = "select 'urn:kg:vec/' || vec_id as id, list_dot_product(embedding::double[], q.v) / sqrt(list_dot_product(embedding::double[], embedding::double[])) / sqrt(list_dot_product(q.v, q.v)) as score from embeddings, (select embedding::double[] as v from embeddings where vec_id = 0) q"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return R.read(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"select id, round(score, 6) as score from ({_VEC}) where score >= 0 order by score desc, id limit 10")
def q_vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = R.read(spark, sf_dir, "embeddings").select(R.node("vec", "vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.vector_top(vectors, _query_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


_LEGS = _BM25 + f", lx as (select id, row_number() over (order by round(score, 9) desc, id) as rank from (select * from r order by round(score, 9) desc, id limit 10)), vx as (select replace(id, 'vec', 'doc') as id, row_number() over (order by round(score, 9) desc, id) as rank from (select * from ({_VEC}) where score >= 0 order by score desc, id limit 10)) "


@query(_LEGS + "select id, round(sum(1.0 / (60 + rank)), 6) as score, case when count(distinct leg) > 1 then 'hybrid' else min(leg) end as via from (select id, rank, 'lexical' as leg from lx union all select id, rank, 'vector' from vx) group by id order by round(sum(1.0 / (60 + rank)), 12) desc, id limit 10")
def q_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = R.read(spark, sf_dir, "embeddings").select(R.node("doc", "vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.hybrid(entries(spark, sf_dir), vectors, " ".join(_TERMS), _query_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), "via")


@query("select coalesce(lang, 'und') as language, count(*) as entries, count(*) as documents from documents group by 1")
def q_entries_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_language(entries(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("entries"), F.count_if(F.col("type") == "Document").alias("documents"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a title, and a heading of the role per turn."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return R.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(turns, "").alias("body")).select(R.node("conv", "conv_id").alias("doc"), F.concat(F.lit("# conv "), "conv_id", F.lit("\n"), "body").alias("content"))


_TURNS = "select 'urn:kg:conv/' || conv_id as doc, turn, role, replace(text, chr(10), ' ') as text, row_number() over (partition by conv_id, role order by turn) - 1 as k from conversations"


@query(f"select doc, 2 as level, role as title, case when k = 0 then role else role || '-' || k end as slug, cast(k as int) as occurrence, trim(text) as own_text from ({_TURNS})")
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.sections(chats(spark, sf_dir)).filter("level = 2").select("doc", "level", "title", "slug", "occurrence", F.trim("own_text").alias("own_text"))


@query("with recursive t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as seq, length(text) as n from conversations), f(conv_id, seq, used, kept, cut) as (select distinct conv_id, 0::bigint, 0::bigint, 0::bigint, false from conversations union all select f.conv_id, t.seq, case when used + n <= 600 then used + n else used end, case when n > 0 and used + n <= 600 then kept + 1 else kept end, cut or used + n > 600 from f join t on t.conv_id = f.conv_id and t.seq = f.seq + 1) select conv_id, cast(max(used) as int) as used, cast(max(kept) as int) as kept, bool_or(cut) as truncated from f group by 1")
def q_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = R.read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), R.node("turn", "turn").alias("iri"), F.col("text").alias("content"))
    return retrieve.assemble(blocks, 600, ["conv_id"]).select("conv_id", "used", F.when(F.col("iris") == "", 0).otherwise(F.size(F.split("iris", ","))).alias("kept"), "truncated")


@query("with f as (select user_id, event_type, min({'a': ts, 'b': event_id}) as seen, max(ts) as last from events group by 1, 2) select user_id, min(seen.a) as first, max(last) as last, string_agg(event_type, ',' order by seen) as items from f group by 1")
def q_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.appearance(R.read(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("select page_id, sha256(url) as digest, url_encode(url) as segment from pages")
def q_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("digest"), S.segment("url").alias("segment"))


@query("select page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') as scheme, case when contains(url, '#') then regexp_extract(url, '^[^#]*#(.*)$', 1) end as anchor, split_part(url, '#', 1) as target from pages")
def q_links_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, anchor = S.fragment_split("url")
    return R.read(spark, sf_dir, "pages").select("page_id", S.has_scheme("url").alias("scheme"), anchor.alias("anchor"), target.alias("target"))


@query("select p_partkey, v.word, levenshtein(lower(p_brand), v.word) as distance from part, (values ('brand#11'), ('brand#2'), ('brnd#33')) v(word) where levenshtein(lower(p_brand), v.word) <= 2")
def q_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array(*map(F.lit, ("brand#11", "brand#2", "brnd#33")))).alias("word")
    rows = R.read(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("b"), words)
    return rows.withColumn("distance", F.levenshtein("b", "word", 2)).filter("distance >= 0").select("p_partkey", "word", F.col("distance").cast("bigint").alias("distance"))


_FILE = "'urn:quadweave:doc/conv/' || conv_id || '.md'"
_BUILD = " union all ".join([
    _iri("c", _FILE, V.RDF_TYPE, f"'{V.DOCUMENT}'"), _lit("c", _FILE, V.PATH, "'conv/' || conv_id || '.md'"), _lit("c", _FILE, V.CONTENT_HASH, "sha256(content)"), _lit("c", _FILE, V.TITLE, "'conv ' || conv_id"),
    _iri("h", "s", V.RDF_TYPE, f"'{V.SECTION}'"), _lit("h", "s", V.TITLE, "title"), _lit("h", "s", V.LEVEL, "level"), _lit("h", "s", V.ORDER, "k"), _iri("h", "parent", V.HAS_PART, "s"),
])


@query(
    "with t as (select conv_id, role, replace(text, chr(10), ' ') as text, row_number() over (partition by conv_id order by turn, role, text) as k, row_number() over (partition by conv_id, role order by turn, text) - 1 as again from conversations), "
    "c as (select conv_id, '# conv ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || text || chr(10), '' order by k) as content from t group by 1), "
    f"h as (select {_FILE} || '#conv-' || conv_id as s, 'conv ' || conv_id as title, 1 as level, 1 as k, {_FILE} as parent from c union all select {_FILE} || '#' || role || case when again > 0 then '-' || again else '' end, role, 2, k, {_FILE} || '#conv-' || conv_id from t) "
    + _BUILD
)
def q_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = chats(spark, sf_dir).select(F.concat(F.regexp_replace("doc", "^urn:kg:", ""), F.lit(".md")).alias("path"), "content")
    return derive.derive(markdown.parse(files), derive.Options(sources=("frontmatter", "sections"))).select("s", "p", "o_kind", "o_value")


_SHORT = f"case when o_kind = 'iri' then case when starts_with(o_value, '{V.NS}') then 'qw:' || substr(o_value, {len(V.NS) + 1}) else '<' || o_value || '>' end else '\"' || replace(replace(o_value, '\\', '\\\\'), '\"', '\\\"') || '\"' end"


@query(
    f"with o as (select s, p, string_agg({_SHORT}, ', ' order by o_kind, o_value) as objects from (select distinct s, p, o_kind, o_value from ({_STAR})) group by 1, 2) "
    f"select s, '<' || s || '> ' || string_agg(case when p = '{V.RDF_TYPE}' then 'a' else 'dcterms:' || substr(p, {len(V.PREFIXES['dcterms']) + 1}) end || ' ' || objects, ' ;' || chr(10) || '  ' order by p <> '{V.RDF_TYPE}', p) || ' .' as block from o group by s"
)
def q_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.turtle_blocks(R.star(spark, sf_dir))
