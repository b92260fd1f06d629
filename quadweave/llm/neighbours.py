"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded
sample; every vector is indexed, in the lists of its few nearest centroids.  A
query probes the lists whose centroids have the largest inner product with it,
ranks their vectors by asymmetric distance tables, and the best of each group
of lists are scored again on the original vectors, in double precision.

How many lists a query probes is measured, not guessed: a bounded sample of
the queries is searched exactly against all rows, and the fewest probes are
taken whose lists hold ``target`` of those neighbours.  Lists near each other
form groups of bounded size, one group is one unit of work, and a list that is
larger than a group is cut, so a vector that a third of the rows repeat is
spread over many tasks.  Within a task the group's vectors come first and the
queries pass by in batches, so neither is replicated and memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows the index is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Lists per square root of the number of rows, most lists, lists of a vector, parts of a residual and codes of a part.
LIST_FACTOR, MAX_LISTS, LISTS_EACH, PARTS, CODES = 4, 1024, 2, 16, 256
#: Queries whose neighbours are found exactly to choose the number of probes, and the share of those neighbours that the probed lists must hold.
MEASURED, TARGET = 200, 0.96
#: Vectors of a group of lists, about, and how many of a group are scored exactly for each result asked for, at least.
GROUP_ROWS, RERANK = 8_000, 8
#: All others are too whose estimate is short of the group's ``k``-th best score by fewer standard deviations of its error.
ERRORS = 2.5
#: Queries that go through a group together.
QUERY_BLOCK = 256


def kmeans(rows: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; fewer centroids if there are fewer distinct rows."""
    distinct = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype("float64")
    for _ in range(rounds if len(distinct) > k else 0):
        near = nearest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, weights=column, minlength=len(centres)) for column in rows.T], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return several_nearest(rows, centres, 1)[:, 0]


def several_nearest(rows: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    k = min(k, len(centres))
    out = np.empty((len(rows), k), "int64")
    half = (centres**2).sum(axis=1) / 2
    for at in range(0, len(rows), 4096):
        d = half - rows[at : at + 4096] @ centres.T
        if k == 1:
            out[at : at + 4096, 0] = d.argmin(axis=1)
        else:
            some = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[at : at + 4096] = np.take_along_axis(some, np.take_along_axis(d, some, 1).argsort(axis=1, kind="stable"), 1)
    return out


class Index:
    """Centroids ``(lists, dims)`` and residual codebooks ``(parts, codes, dims / parts)``, zero-padded to whole parts."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES) -> None:
        self.dims = sample.shape[1]
        self.parts = min(parts, self.dims)
        self.width = -(-self.dims // self.parts)
        centres = kmeans(sample, lists)
        # lists that lie together get numbers that lie together
        coarse = kmeans(centres, max(1, int(len(centres) ** 0.5)), seed=3)
        self.centres = centres[np.lexsort((np.arange(len(centres)), nearest(centres, coarse)))]
        residuals = self.pad(sample - self.centres[nearest(sample, self.centres)])
        self.books = [kmeans(np.ascontiguousarray(residuals[:, p * self.width : (p + 1) * self.width]), codes, seed=p) for p in range(self.parts)]

    def pad(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.parts * self.width - self.dims)))

    def encode(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Codes ``(rows, parts)`` of the residuals from the centroids of ``lists``."""
        residuals = self.pad(rows - self.centres[lists])
        return np.stack([nearest(residuals[:, p * self.width : (p + 1) * self.width], book) for p, book in enumerate(self.books)], axis=1).astype("uint8")

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Per part ``(codes, queries)``: each code's share of the inner product."""
        padded = self.pad(queries)
        return [np.ascontiguousarray((padded[:, p * self.width : (p + 1) * self.width] @ book.T).T.astype("float32")) for p, book in enumerate(self.books)]

    def order(self, queries: np.ndarray) -> np.ndarray:
        """All lists in the order in which each query probes them."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids; one place for equal ids with equal scores."""
    order = np.lexsort((ids, -scores))
    i, s = ids[order], scores[order]
    fresh = np.r_[True, (i[1:] != i[:-1]) | (s[1:] != s[:-1])] if order.size else np.zeros(0, bool)
    return order[fresh][:k]


class Group:
    """The vectors of one group of lists."""

    def __init__(self, index: Index, lists: np.ndarray, ids: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((ids, lists))
        self.index, self.lists, self.ids, self.codes, self.rows = index, lists[order], ids[order], codes[order], rows[order]
        self.numbers, self.starts = np.unique(self.lists, return_index=True)
        self.ends = np.r_[self.starts[1:], self.lists.size]
        coded = np.concatenate([book[self.codes[:, p]] for p, book in enumerate(index.books)], axis=1)
        lost = index.pad(self.rows - index.centres[self.lists]) - coded
        self.slack = ERRORS * np.sqrt((lost**2).sum(axis=1) / index.dims)

    def search(self, ids: np.ndarray, queries: np.ndarray, probed: list[np.ndarray], k: int) -> tuple[np.ndarray, ...]:
        """For each query its ``k`` best of the probed lists: estimated by tables, then exact for those that may be among them."""
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(queries), QUERY_BLOCK):
            block = queries[at : at + QUERY_BLOCK]
            tables, near = self.index.tables(block), (block @ self.index.centres[self.numbers].T).astype("float32")
            guess = np.full((self.ids.size, len(block)), -np.inf, "float32")
            mine = [np.concatenate([np.zeros(0, "int64"), p]) for p in probed[at : at + QUERY_BLOCK]]
            asked = np.zeros((self.numbers.size, len(block)), bool)
            for q, p in enumerate(mine):
                asked[np.searchsorted(self.numbers, p[np.isin(p, self.numbers)]), q] = True
            for n, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
                who = np.flatnonzero(asked[n])
                if who.size:
                    part = np.repeat(near[who, n][None, :], b - a, axis=0)
                    for p, t in enumerate(tables):
                        part += t[:, who][self.codes[a:b, p]]
                    guess[a:b, who] = part
            take = min(self.ids.size, k * RERANK + 1)
            guess = np.ascontiguousarray(-guess.T)
            for q, query in enumerate(block):
                row = guess[q]
                worst = np.partition(row, take - 1)[take - 1]
                sure = np.flatnonzero(row < worst)
                some = np.r_[sure, np.flatnonzero(row == worst)[: take - sure.size]]  # a list's smaller ids first
                some = some[(row[some] < np.inf) & (self.ids[some] != ids[at + q])]
                score = (self.rows[some] * query).sum(axis=1)
                if take < row.size and some.size >= k:
                    level = np.partition(score, some.size - k)[some.size - k]
                    near_enough = self.slack * np.sqrt((query**2).sum()) - row >= level
                    near_enough[some] = False
                    more = np.flatnonzero(near_enough & (self.ids != ids[at + q]))
                    some, score = np.r_[some, more], np.r_[score, (self.rows[more] * query).sum(axis=1)]
                best = best_of(self.ids[some], score, k)
                found.append((np.full(best.size, ids[at + q]), self.ids[some][best], score[best]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors from a binary column of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dims)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], "binary")


def measured_probes(rows: DataFrame, queries: DataFrame, index: Index, k: int, target: float, measured: int = MEASURED) -> int:
    """The fewest probes whose lists hold ``target`` of the true neighbours of a sample of queries.

    ``rows`` and ``queries`` have ``id`` and ``v``.  Each task tells its own
    best ``k`` rows of each of the ``measured`` queries and at which probe
    they'd be met; the driver receives ``k`` rows for each of those queries.
    """
    spark = rows.sparkSession
    asked = [(r["id"], np.frombuffer(r["v"], "<f8")) for r in queries.orderBy(F.xxhash64("id"), "id").limit(measured).collect()]
    if not asked:
        return 1
    ids, m = np.array([i for i, _ in asked]), np.stack([v for _, v in asked])
    place = np.argsort(index.order(m), axis=1)
    shared = spark.sparkContext.broadcast((index, ids, m, place))

    def exact_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, m, place = shared.value
        best = [(np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64"))] * len(ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v, own = _matrix(part.column("v"), index.dims), part.column("id").to_numpy()
                lists = several_nearest(v, index.centres, LISTS_EACH)
                score = m @ v.T
                for q in range(len(ids)):
                    i, s, at_ = best[q]
                    worth = np.flatnonzero((score[q] > (s.min() if s.size >= k else -np.inf)) & (own != ids[q]))
                    if worth.size:
                        i, s, at_ = np.r_[i, own[worth]], np.r_[s, score[q, worth]], np.r_[at_, place[q, lists[worth]].min(axis=1)]
                        top = best_of(i, s, k)
                        best[q] = i[top], s[top], at_[top]
        q = np.repeat(ids, [b[0].size for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(np.concatenate([b[c] for b in best])) for c in range(3))], ["q", "id", "score", "at"])

    found = rows.select("id", "v").mapInArrow(exact_best, "q long, id long, score double, at long")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    at = np.sort([r["at"] for r in found.withColumn("_n", first).filter(F.col("_n") <= k).select("at").collect()])
    return int(at[int(np.ceil(target * at.size)) - 1]) + 1 if at.size else 1


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, target: float = TARGET, report: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest of each row whose id ``every`` divides.

    Vectors that are null, zero, of another length than most, or that hold
    null or non-finite components take no part, nor do rows with a null id.
    Rows that share an id are each a candidate, but equal ones count once, and
    the query is the smallest vector; ties go to the smaller id.  An empty
    table gives no rows.  ``report`` receives the numbers of lists, probes and
    groups.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(finite)
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()}  # one row per length
    if not sizes:
        return spark.createDataFrame([], schema)
    dims = max(sizes, key=lambda n: (sizes[n], n))
    total = sizes[dims]
    rows = rows.filter(F.size("v") == dims)
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(FIT_ROWS).collect()])
    index = Index(sample, lists or int(np.clip(LIST_FACTOR * np.sqrt(total), 1, MAX_LISTS)))
    shared = spark.sparkContext.broadcast(index)  # MAX_LISTS centroids and PARTS * CODES code vectors
    n_lists = len(index.centres)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _bytes(m)], ["id", "v"])

    pack = lambda df: df.mapInArrow(packed, "id long, v binary")
    queries = pack(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    rows = pack(rows.select("id", "v"))
    probes = min(n_lists, measured_probes(rows, queries, index, k, target))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), dims)
            near = several_nearest(m, shared.value.centres, LISTS_EACH)
            at = np.repeat(np.arange(len(m)), near.shape[1])
            codes = shared.value.encode(m[at], near.ravel())
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), "int32"), batch.column("id").take(take), _bytes(codes), batch.column("v").take(take)], ["list", "id", "codes", "v"])

    def list_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_lists, "int64")
        for batch in batches:
            n += np.bincount(several_nearest(_matrix(batch.column("v"), dims), shared.value.centres, LISTS_EACH).ravel(), minlength=n_lists)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["list", "n"])

    counts = np.zeros(n_lists, "int64")
    for r in rows.mapInArrow(list_sizes, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # MAX_LISTS rows
        counts[r["list"]] = r["n"]
    # neighbouring lists fill a group; a large list has groups of its own
    first, cells, group, filled = np.zeros(n_lists, "int64"), np.ones(n_lists, "int64"), 0, 0
    for i, n in enumerate(counts):
        if filled and filled + n > GROUP_ROWS:
            group, filled = group + 1, 0
        first[i], cells[i] = group, max(1, -(-n // GROUP_ROWS))
        group, filled = (group + cells[i], 0) if cells[i] > 1 else (group, filled + n)
    n_groups = int(group + 1)
    if report is not None:
        report |= {"rows": total, "lists": n_lists, "probes": probes, "groups": n_groups, "entries": int(counts.sum())}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = shared.value.order(_matrix(batch.column("v"), dims))[:, :probes]
            at, groups, probed = [], [], []
            for q, own in enumerate(chosen):
                own = np.sort(own)
                cell = np.repeat(first[own], cells[own]) + np.arange(cells[own].sum()) - np.repeat(np.cumsum(cells[own]) - cells[own], cells[own])
                of = np.repeat(own, cells[own])
                for g in np.unique(cell):
                    at.append(q)
                    groups.append(g)
                    probed.append(of[cell == g].astype("<i4").tobytes())
            take = pa.array(at, "int64")
            yield pa.RecordBatch.from_arrays([pa.array(groups, "int32"), batch.column("id").take(take), pa.array(probed, "binary"), batch.column("v").take(take)], ["group", "id", "codes", "v"])

    pick = lambda of: F.element_at(F.array(*(F.lit(int(c)) for c in of)), F.col("list") + 1)
    members = rows.mapInArrow(listed, "list int, id long, codes binary, v binary")
    members = members.select((pick(first) + F.pmod(F.xxhash64("id", "v"), pick(cells))).cast("int").alias("group"), F.lit(0).alias("kind"), "list", "id", "codes", "v")
    asked = queries.mapInArrow(probe, "group int, id long, codes binary, v binary").select("group", F.lit(1).alias("kind"), F.lit(0).alias("list"), "id", "codes", "v")
    work = members.unionByName(asked).repartition(max(1, n_groups), "group").sortWithinPartitions("group", "kind")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ready = None, [], None
        for batch in batches:
            of = batch.column("group").to_numpy() * 2 + batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if of.size else np.zeros(0, "int64")
            for a, b in zip(edges, np.r_[edges[1:], of.size], strict=False):
                run = batch.slice(a, b - a)
                if of[a] // 2 != number:
                    number, held, ready = of[a] // 2, [], None
                if of[a] % 2 == 0:
                    held.append(run)
                elif held or ready:
                    if ready is None:
                        lists_, own = (np.concatenate([r.column(c).to_numpy() for r in held]) for c in ("list", "id"))
                        codes = np.frombuffer(b"".join(x for r in held for x in r.column("codes").to_pylist()), "uint8").reshape(own.size, -1)
                        ready, held = Group(shared.value, lists_, own, codes, np.concatenate([_matrix(r.column("v"), dims) for r in held])), []
                    probed = [np.frombuffer(x, "<i4").astype("int64") for x in run.column("codes").to_pylist()]
                    q, c, s = ready.search(run.column("id").to_numpy(), _matrix(run.column("v"), dims), probed, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, "int64"), pa.array(c, "int64"), pa.array(s, "float64")], ["query_id", "vec_id", "score"])

    found = work.mapInArrow(score, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(ids: np.ndarray, rows: np.ndarray, k: int = 20, every: int = 20) -> dict[int, list[tuple[int, float]]]:
    """Brute force over all candidates, for measuring recall."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (rows * rows[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score))[: k + 1] if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out
