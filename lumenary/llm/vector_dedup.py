"""Near-duplicate vectors by product quantisation over inverted lists, reranked exactly.

Vectors are assigned to the coarse centroid that is most alike (inverted lists), and what the
centroid leaves is coded subspace by subspace. A query looks in every list that can hold a partner:
not in one whose members' angles to its centroid are all too far from the query's own, nor in one
whose side of the plane between its centroid and the query's is too far away. In a list the
query's similarity to a coded vector is one table look-up for each subspace (asymmetric distance),
and with the length of the coding error, which the index keeps, that bounds the true cosine from
above. Only vectors whose bound reaches the threshold are compared, in double precision. So
neither lists nor coding lose a pair. Where vectors have no groups, no list can be left out, and
look-ups grow with the square of the table.

Equal vectors are one entry with a count. Lists that lie together are a region of bounded size.
Regions and the queries for them are cut into blocks, and a task compares one block of either; it
gives counts and a spanning forest of its links, so pairs inside a large group never leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import checkpointed
from lumenary.llm.components import components

#: Vectors and queries of a block; a region has no more vectors, but for a longer list.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 4096
#: Queries looked up at once, and room for rounding in bounds.
STRIP, ROOM = 1024, 1e-5


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre at least squared distance."""
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


def _centres(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means; a centre that loses all its vectors keeps its place."""
    pick = np.random.default_rng(seed).permutation(len(x))[:k]
    centres = x[pick].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


@dataclass
class Quantiser:
    """Coarse centroids (unit length) and, for each subspace, the codes' vectors."""

    coarse: np.ndarray
    codes: np.ndarray  # subspace, code, dimension of the subspace

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, seed: int = 7, rounds: int = 8) -> Quantiser:
        """``x``: unit vectors; the dimension must be a multiple of ``subspaces``."""
        coarse = _centres(x, min(lists, len(x)), rounds, seed)
        coarse /= np.maximum(np.linalg.norm(coarse, axis=1, keepdims=True), 1e-12)
        rest = x - coarse[np.argmax(x @ coarse.T, axis=1)]
        parts = rest.reshape(len(x), subspaces, -1)
        codes = [_centres(parts[:, j], min(256, len(x)), rounds, seed + 1 + j) for j in range(subspaces)]
        return cls(coarse, np.stack(codes))

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most alike list of each vector, and the cosine to its centroid."""
        like = x @ self.coarse.T
        most = np.argmax(like, axis=1)
        return most, like[np.arange(len(x)), most]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector in its list, and the length of the error they leave."""
        rest = (x - self.coarse[own]).reshape(len(x), len(self.codes), -1)
        codes = np.stack([_nearest(rest[:, j], book) for j, book in enumerate(self.codes)], axis=1)
        left = rest - np.stack([book[codes[:, j]] for j, book in enumerate(self.codes)], axis=1)
        return codes.astype(np.uint8), np.sqrt((left * left).sum((1, 2)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Similarity of every code of every subspace to every query, in single precision."""
        parts = queries.reshape(len(queries), len(self.codes), -1)
        return np.stack([book @ parts[:, j].T for j, book in enumerate(self.codes)]).astype(np.float32)

    def lookup(self, tables: np.ndarray, to_list: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Similarity of every coded vector of a list to every query, from the queries' tables.

        ``to_list``: the queries' similarity to the list's centroid.
        """
        out = np.repeat(to_list.astype(np.float32)[None, :], len(codes), axis=0)
        for j, table in enumerate(tables):
            out += table[codes[:, j]]
        return out


@dataclass
class Reach:
    """Which lists can hold a vector whose cosine to a query is at least ``least``.

    ``low`` and ``high``: least and greatest angle of each list's members to its centroid;
    a list without members has ``high`` below any angle. ``region``: the region of each list.
    """

    coarse: np.ndarray
    low: np.ndarray
    high: np.ndarray
    region: np.ndarray
    least: float

    def lists(self, x: np.ndarray, own: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, of list ``own``, and each list of ``some``: whether, and the similarity to the centroid."""
        like = x @ self.coarse[some].T
        far = np.arccos(np.clip(self.least, -1, 1))
        angle = np.arccos(np.clip(like, -1, 1))
        on = (angle <= self.high[some] + far + ROOM) & (angle >= self.low[some] - far - ROOM)
        # members are at least as like their centroid as the query's; the plane between cuts the sphere
        between = np.sqrt(np.maximum(2 - 2 * self.coarse[own] @ self.coarse[some].T, 0))
        lead = np.einsum("nd,nd->n", x, self.coarse[own])[:, None] - like
        return on & (lead <= np.sin(min(far, np.pi / 2)) * between + ROOM), like

    def regions(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each query and region: whether one of its lists can."""
        order = np.argsort(self.region, kind="stable")
        starts = np.searchsorted(self.region[order], np.arange(self.region.max() + 1))
        step = max(1, (1 << 20) // len(order))
        return np.concatenate(
            [np.logical_or.reduceat(self.lists(x[k : k + step], own[k : k + step], order)[0], starts, axis=1) for k in range(0, len(x), step)]
        )


def _regions(coarse: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Lists halved between two far ones until a part has ``most`` members or is one list."""
    out, parts, n = np.zeros(len(coarse), np.int64), [np.arange(len(coarse))], 0
    while parts:
        some = parts.pop()
        total = sizes[some].sum()
        if len(some) == 1 or total <= most:
            out[some], n = n, n + 1
            continue
        here = coarse[some]
        one = here[np.argmin(here @ here[0])]
        other = here[np.argmin(here @ one)]
        some = some[np.argsort(here @ (one - other), kind="stable")]
        cut = int(np.clip(np.searchsorted(np.cumsum(sizes[some]), total / 2), 1, len(some) - 1))
        parts += [some[:cut], some[cut:]]
    return out


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and of unit length."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(batch_column), -1)
    # by the greatest component first, so that neither squares nor their sum leave the range
    scaled = x / np.abs(x).max(1, keepdims=True)
    return x, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Forest:
    """Components of numbers below n, and which of the links given joined them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            on = a != b
            if not on.any():
                return
            i, j = i[on], j[on]
            low, high = np.minimum(a, b)[on], np.maximum(a, b)[on]
            # every label to its first neighbour of a lower one, so that no circle arises
            high, first = np.unique(high, return_index=True)
            self.kept.append((i[first], j[first]))
            to = np.arange(len(self.label))
            to[high] = low[first]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def _at_least(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs ``x[i], y[j]`` whose cosine is at least ``least``."""
    if not len(i):
        return i, j
    a, b, c, d = i.min(), i.max() + 1, j.min(), j.max() + 1
    sure = np.zeros(len(i), bool)
    open_ = np.ones(len(i), bool)
    if len(i) * 64 > (b - a) * (d - c):  # enough of a rectangle: one product tells all but the closest
        like = (x[a:b].astype(np.float32) @ y[c:d].T.astype(np.float32))[i - a, j - c]
        open_ = np.abs(like - least) < ROOM
        sure = (like >= least) & ~open_
    # the same sum in either direction, so that both ends of a link agree
    for k in np.array_split(np.flatnonzero(open_), len(i) // (1 << 16) + 1):
        sure[k] = np.einsum("nd,nd->n", x[i[k]], y[j[k]]) >= least
    return i[sure], j[sure]


def fit_quantiser(
    vectors: DataFrame, *, lists: int | None = None, subspaces: int = 8, most_rows: int = 20_000, column: str = "vector"
) -> Quantiser | None:
    """Fitted on ``most_rows`` vectors at most, those of least hash of their id (``node``)."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(most_rows).select(column).toArrow().column(column).combine_chunks()
    if not len(sample):
        return None
    if isinstance(sample, pa.ChunkedArray):
        sample = pa.concat_arrays(sample.chunks)
    _, x = _unit(sample)
    lists = lists or int(np.clip(np.sqrt(n), 1, 4096))
    while x.shape[1] % subspaces:
        subspaces -= 1
    return Quantiser.fit(x, lists, subspaces)


def near_duplicates(
    vectors: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", **fitting
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Two rows link when their cosine is at least ``least``. ``n_links`` counts other rows, copies
    each for itself. Rows whose vector is null, zero, has a null or non-finite component, or another
    length than most usable ones (of lengths as common, the least) link with nothing. A component
    is named by its least id; ids should be unique, and rows that repeat one are told apart by
    their vectors only. An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    fine = rows.filter(usable(F.col("vector")))
    entries = checkpointed(fine.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    lengths = entries.groupBy(F.size("vector").alias("length")).agg(F.sum("copies").alias("n"))
    length = (lengths.orderBy(F.desc("n"), "length").first() or [0])[0]
    entries = entries.filter(F.size("vector") == length)
    alone = lambda some: some.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    model = fit_quantiser(entries, **fitting)
    if model is None:
        return alone(rows)
    context = rows.sparkSession.sparkContext
    held = context.broadcast(model)  # lists and codes: a fixed number of vectors

    def index(batches):
        model = held.value
        for batch in batches:
            _, x = _unit(batch.column(0))
            own, like = model.own(x)
            codes, error = model.encode(x, own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32)), pa.array(like), pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(error)],
                names=["vector", "node", "copies", "list", "like", "codes", "error"],
            )

    kind = entries.schema["vector"].dataType.simpleString()
    shape = f"vector {kind}, node long, copies long, list int, like double, codes binary, error double"
    indexed = checkpointed(entries.mapInArrow(index, shape))

    # lists are as many as centroids, so the driver may hold what is known of them
    n_lists = len(model.coarse)
    members, low, high = np.zeros(n_lists, np.int64), np.zeros(n_lists), np.full(n_lists, -10.0)
    for k, n, a, b in indexed.groupBy("list").agg(F.count("*"), F.max("like"), F.min("like")).collect():
        members[k], low[k], high[k] = n, np.arccos(np.clip(a, -1, 1)), np.arccos(np.clip(b, -1, 1))
    region = _regions(model.coarse, members, BLOCK_VECTORS)
    bound = context.broadcast(Reach(model.coarse, low, high, region, least))

    def reached(batches):
        for batch in batches:
            if batch.num_rows:
                _, x = _unit(batch.column(0))
                query, at = np.nonzero(bound.value.regions(x, batch.column(3).to_numpy()))
                ends = np.searchsorted(query, np.arange(len(x) + 1)).astype(np.int32)
                regions = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, regions], names=["vector", "node", "copies", "own", "regions"])

    queries = indexed.select("vector", "node", "copies", F.col("list").alias("own"))
    queries = checkpointed(queries.mapInArrow(reached, f"vector {kind}, node long, copies long, own int, regions array<int>"))
    asking = dict(queries.select(F.explode("regions").alias("region")).groupBy("region").count().collect())
    n_regions = int(region.max()) + 1
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
    m = constant(-(-np.bincount(region, members, n_regions).astype(int) // BLOCK_VECTORS))
    q = constant(-(-asking.get(k, 0) // BLOCK_QUERIES) for k in range(n_regions))
    hashed = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = (
        indexed.withColumn("region", constant(region)[F.col("list")])
        .withColumn("mb", F.pmod(hashed, m[F.col("region")]).cast("int")).withColumn("qb", every(q[F.col("region")]))
        .select("region", "mb", "qb", "list", "node", "copies", "vector", "codes", "error")
    )
    asks = (
        queries.select("node", "copies", "vector", "own", F.explode("regions").alias("region"))
        .withColumn("qb", F.pmod(hashed, q[F.col("region")]).cast("int")).withColumn("mb", every(m[F.col("region")]))
        .select("region", "mb", "qb", F.col("node").alias("q_node"), F.col("vector").alias("q_vector"), "own")
    )

    def compare(block: pa.Table, queries: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 3
        if block.num_rows and queries.num_rows:
            model, reach = held.value, bound.value
            block = block.sort_by("list")
            one = lambda table, name: table.column(name).combine_chunks()
            _, ux = _unit(one(block, "vector"))
            _, uy = _unit(one(queries, "q_vector"))
            codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), np.uint8).reshape(len(ux), -1)
            node, copies, lists = (block.column(c).to_numpy() for c in ("node", "copies", "list"))
            error = block.column("error").to_numpy().astype(np.float32)[:, None]
            q_node, own = queries.column("q_node").to_numpy(), queries.column("own").to_numpy()
            names, at = np.unique(np.concatenate((q_node, node)), return_inverse=True)
            q_at, x_at = at[: len(q_node)], at[len(q_node) :]
            here, starts = np.unique(lists, return_index=True)
            forest, links = Forest(len(names)), np.zeros(len(uy), np.int64)
            for k in range(0, len(uy), STRIP):
                on, like = reach.lists(uy[k : k + STRIP], own[k : k + STRIP], here)
                tables = model.tables(uy[k : k + STRIP])
                for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ux)])):
                    asked = np.flatnonzero(on[:, n])
                    if not len(asked):
                        continue
                    # where many ask, all look: to copy the tables of some takes longer
                    few = 4 * len(asked) < len(on)
                    asked = asked if few else np.arange(len(on))
                    told, near = (tables[:, :, asked], like[asked, n]) if few else (tables, like[:, n])
                    for c in range(a, b, STRIP):
                        e = min(b, c + STRIP)
                        # what may be linked: the bound, with room for rounding
                        may = model.lookup(told, near, codes[c:e]) + error[c:e] >= least - ROOM
                        i, j = np.nonzero(may)
                        i, j = i + c, asked[j] + k
                        i, j = _at_least(ux, uy, i, j, least)
                        other = node[i] != q_node[j]
                        i, j = i[other], j[other]
                        links += np.bincount(j, copies[i], len(uy)).astype(np.int64)
                        forest.add(x_at[i], q_at[j])
            some = np.flatnonzero(links)
            left, right = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*forest.kept) if forest.kept else ((), ())))
            columns = [np.concatenate((q_node[some], names[left])), np.concatenate((np.full(len(some), -1), names[right])), np.concatenate((links[some], np.zeros(len(left), np.int64)))]
        a, b, links = columns
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=links > 0), "links": pa.array(links, pa.int64())})

    blocks = ["region", "mb", "qb"]
    found = checkpointed(mine.groupBy(*blocks).cogroup(asks.groupBy(*blocks)).applyInArrow(compare, "a long, b long, links long"))
    labels = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = (
        entries.join(counts, "node", "left").join(labels, "node", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    named = checkpointed(named)
    # a vector that many rows have makes a skewed side here, which adaptive execution splits
    may = usable(F.col("vector")) & (F.size("vector") == length)
    told = rows.filter(may).join(named, "vector").select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    return told.unionByName(alone(rows.filter(~may)))
