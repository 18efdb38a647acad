"""The k most similar vectors of every vector: inverted file, product-quantised residuals,
asymmetric distance tables, exact reranking (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siltstone.runtime import settle

DECIMALS = 12


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_closest(part, centres, spherical) for part in np.array_split(rows, max(1, len(rows) // 4096))])
        order = np.argsort(nearest, kind="stable")
        starts = np.searchsorted(nearest[order], np.arange(k))
        counts = np.diff(np.append(starts, len(rows)))
        used = counts > 0
        centres[used] = np.add.reduceat(rows[order], starts[used]) / counts[used][:, None]
        if spherical:
            centres = _unit(centres).astype(rows.dtype)
        if (~used).any():  # an empty centre moves to a row of the sample
            centres[~used] = rows[rng.choice(len(rows), int((~used).sum()))]
    return centres


def _closest(rows: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    score = rows @ centres.T
    if not spherical:
        score -= (centres**2).sum(1) / 2
    return score.argmax(1)


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest values of each row, largest first, ties to the first column."""
    n, width = min(n, score.shape[1]), score.shape[1]
    least = np.partition(score, width - n, axis=1)[:, width - n]
    at = np.flatnonzero(score >= least[:, None])
    row, col = np.divmod(at, width)
    order = np.lexsort((-score.ravel()[at], row))
    return col[order][np.searchsorted(row, np.arange(len(score)))[:, None] + np.arange(n)]


class Codebook:
    """A tree of two levels of coarse centroids (cells, and lists within each) of one vector
    space, and its residual sub-quantisers."""

    def __init__(self, cells: np.ndarray, lists: list[np.ndarray], fine: list[np.ndarray] | None = None):
        self.cells, self.width = cells, cells.shape[1]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])  # number of each cell's first list
        self.lists, self.fine = np.concatenate(lists), fine

    def nearest(self, rows: np.ndarray, most: int, probes: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(lists, inner products) of the ``most`` nearest lists of each row, nearest first, among
        those of the nearest ``probes`` cells; -inf where a row has fewer."""
        probes = min(probes, len(self.cells))
        sizes = np.diff(self.first)
        widest = int(sizes.max())
        near, value = [], []
        for part in np.array_split(rows, len(rows) // max(1, min(2048, (1 << 24) // (probes * widest))) + 1):
            cells = _best(part @ self.cells.T, probes)
            met = np.full((len(part), probes, widest), -np.inf, np.float32)
            order = np.argsort(cells, axis=None, kind="stable")
            ends = np.searchsorted(cells.ravel()[order], np.arange(len(self.cells) + 1))
            for cell in np.flatnonzero(np.diff(ends)):
                row, slot = np.divmod(order[ends[cell] : ends[cell + 1]], probes)
                met[row, slot, : sizes[cell]] = part[row] @ self.lists[self.first[cell] : self.first[cell + 1]].T
            met = met.reshape(len(part), -1)
            best = _best(met, most)
            value.append(np.take_along_axis(met, best, 1))
            near.append(self.first[np.take_along_axis(cells, best // widest, 1)] + best % widest)
        return np.concatenate(near), np.concatenate(value)

    @property
    def edges(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([c.shape[1] for c in self.fine])])

    def codes(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([_closest(residual[:, a:b], c, False) for a, b, c in zip(self.edges, self.edges[1:], self.fine)])

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each part, the inner product of every query with every fine centroid."""
        return [queries[:, a:b] @ c.T for a, b, c in zip(self.edges, self.edges[1:], self.fine)]


def usable(vector: Column, dimension: Column) -> Column:
    """Length equals the dimension, every value finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """(embedding_model, embedding_revision, chunk_id, vector): the row with the latest
    created_at of each key (null is oldest, ties to the larger vector), if it is usable."""
    keys = ["embedding_model", "embedding_revision", "chunk_id"]
    rows = vectors.where(F.col("chunk_id").isNotNull())
    last = rows.groupBy(*keys).agg(F.max(F.struct("created_at", "vector", "embedding_dimension")).alias("_m"))
    return last.where(usable(F.col("_m.vector"), F.col("_m.embedding_dimension"))).select(*keys, F.col("_m.vector").alias("vector"))


def _file(books, spread: int, slack: float):
    """File each vector under its nearest lists, further ones only as far as ``slack`` allows.
    It asks and is found in all of them (_role 3, or 7 where there are several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (name, width), part in _by_space(batch):
                unit = _unit(_matrix(part.column("vector"), width).astype(np.float32))
                near, value = books.value[name, width].nearest(unit, spread)
                far = 2 - 2 * value  # squared distance of unit vectors
                kept = far <= (1 + slack) ** 2 * far[:, :1] + 1e-6
                kept[:, 0] = True
                row, rank = np.nonzero(kept)
                several = kept.sum(1)[row] > 1
                taken = part.take(pa.array(row))
                role = np.where(several, 7, 3)
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near[row, rank].astype(np.int32)), pa.array(role.astype(np.int32))], names=[*taken.schema.names, "_list", "_role"])

    return run


def _by_space(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    space = np.array([f"{m}\x1f{r}" for m, r in zip(batch.column("embedding_model").to_pylist(), batch.column("embedding_revision").to_pylist())], object)
    sizes = _sizes(batch.column("vector"))
    for name, width in sorted({(n, int(w)) for n, w in zip(space, sizes)}):
        yield (name, width), batch.take(pa.array(np.flatnonzero((space == name) & (sizes == width))))


def _sizes(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _first_copies(rows: np.ndarray, most: int) -> np.ndarray:
    """Indices, in order, of the rows that are among the first ``most`` with the same values."""
    same = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    place = np.empty(len(rows), int)
    place[order] = np.arange(len(rows)) - np.searchsorted(same[order], same[order])
    return np.flatnonzero(place < most)


def _search(books, k: int, depth: int, least: float):
    """One inverted list: score by distance tables, rerank the best exactly. ``_role`` of an
    answer is that of the asking row."""

    def run(group: pa.Table) -> pa.Table:
        width = len(group.column("vector")[0])
        first = group.slice(0, 1).to_pylist()[0]
        book = books.value[f"{first['embedding_model']}\x1f{first['embedding_revision']}", width]
        roles = group.column("_role").to_numpy(zero_copy_only=False)
        raw = _matrix(group.column("vector"), width)
        ids = group.column("chunk_id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids)  # the smaller id first, so that ties fall to it
        raw, ids, roles = raw[order], ids[order], roles[order]
        base, asks = np.flatnonzero(roles & 1), np.flatnonzero(roles & 2)
        if len(base):  # of a vector's copies only the k + 1 smallest ids can be among anyone's first k
            base = base[_first_copies(raw[base], k + 1)]
        centre = book.lists[first["_list"]]
        unit = _unit(raw.astype(np.float64))
        small = unit.astype(np.float32)
        code = book.codes(small[base] - centre) if len(base) > depth else None
        found = []
        for part in np.array_split(asks, max(1, len(asks) // 256 + 1)):
            if not len(part) or not len(base):
                continue
            if code is None:  # all are reranked
                near = np.tile(base, (len(part), 1))
            else:
                score = np.repeat((small[part] @ centre)[:, None], len(base), 1)
                for table, row in zip(book.tables(small[part]), code):
                    score += table[:, row]
                score[base[None, :] == part[:, None]] = -np.inf
                near = np.sort(base[np.argpartition(-score, depth - 1, axis=1)[:, :depth]], axis=1)
            exact = np.round(np.einsum("qd,qnd->qn", unit[part], unit[near]), DECIMALS)
            exact[near == part[:, None]] = -np.inf
            best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            exact = np.take_along_axis(exact, best, 1)
            near = np.take_along_axis(near, best, 1)
            row, col = np.nonzero(exact >= least)
            found.append((ids[part[row]], ids[near[row, col]], exact[row, col], roles[part[row]]))
        a, b, s, r = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [], [])
        n = len(a)
        return pa.table(
            {
                "embedding_model": pa.array([first["embedding_model"]] * n, pa.string()),
                "embedding_revision": pa.array([first["embedding_revision"]] * n, pa.string()),
                "chunk_id": pa.array(a, pa.string()),
                "neighbour_id": pa.array(b, pa.string()),
                "similarity": pa.array(s, pa.float64()),
                "_role": pa.array(r, pa.int32()),
            }
        )

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Each chunk_id's first ``k`` answers out of those of the lists it has asked."""
    keys = ["embedding_model", "embedding_revision", "chunk_id"]
    best = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "neighbour_id")))
    met = found.where("_role = 7").groupBy(*keys).agg(best.alias("_best"))
    ids = F.col("_best.neighbour_id")
    once = F.filter("_best", lambda x, i: F.array_position(ids, x["neighbour_id"]) == i + 1)
    several = met.select(*keys, F.explode(F.slice(once, 1, k)).alias("_x")).select(*keys, "_x.neighbour_id", (-F.col("_x.far")).alias("similarity"))
    return found.where("_role = 3").drop("_role").unionByName(several)


def _space() -> Column:
    return F.concat_ws("\x1f", F.coalesce("embedding_model", F.lit("")), F.coalesce("embedding_revision", F.lit("")))


def space_sizes(vectors: DataFrame) -> dict:
    """(rows, distinct vectors, the latter within a few per cent) of each (space, dimension)."""
    distinct = F.approx_count_distinct(F.xxhash64("vector"), 0.01)
    rows = vectors.groupBy(_space().alias("_space"), F.size("vector").alias("_width")).agg(F.count("*").alias("n"), distinct.alias("d"))
    return {(r["_space"], r["_width"]): (r["n"], max(1, r["d"])) for r in rows.collect()}


def sample_vectors(vectors: DataFrame, sizes: dict, wanted: dict, seed: int, most_copies: int, kept_copies: int) -> DataFrame:
    """(_space, _width, vector, _place, _n): about ``wanted`` distinct vectors of each space, drawn
    by hash, so that copies are in or out together and count once. ``_place`` is uniform from
    0 to 1: those under x are a sample of the sample. ``_n`` is the number of rows to be filed."""
    rate = F.coalesce(*[F.when((F.col("_space") == s) & (F.col("_width") == w), F.lit(min(1.0, n / sizes[s, w][1]))) for (s, w), n in wanted.items()])
    draw = F.pmod(F.xxhash64(F.lit(seed), "vector"), F.lit(1 << 30)) / float(1 << 30)
    drawn = vectors.select(_space().alias("_space"), F.size("vector").alias("_width"), "vector").withColumn("_place", draw / rate).where(F.col("_place") < 1)
    filed = F.when(F.count("*") > most_copies, kept_copies).otherwise(F.count("*"))
    return settle(drawn.groupBy("_space", "_width", "vector", "_place").agg(filed.alias("_n")), "sample")


def _fitted(rows: DataFrame, keys: list[str], fit) -> dict:
    """{key: list of float32 matrices} of each group of the sample, fitted in a task of its own;
    only the matrices reach the driver."""

    def run(group: pa.Table) -> pa.Table:
        first = {c: group.column(c)[0].as_py() for c in keys}
        width = first["_width"]
        unit = _unit(_matrix(group.column("vector"), width).astype(np.float32)).astype(np.float32)
        order = np.lexsort(unit.T[::-1])  # the same fit whatever order the rows came in
        made = fit(first, unit[order], group.column("_n").to_numpy()[order])
        return pa.table(
            {c: pa.array([first[c]] * len(made), pa.string() if c == "_space" else pa.int32()) for c in keys}
            | {"_no": pa.array(np.arange(len(made), dtype=np.int32)), "_columns": pa.array([m.shape[1] for m in made], pa.int32()), "_data": pa.array([m.astype(np.float32).tobytes() for m in made], pa.binary())}
        )

    schema = ", ".join(f"{c} {'string' if c == '_space' else 'int'}" for c in keys) + ", _no int, _columns int, _data binary"
    found: dict = {}
    for r in sorted(rows.groupBy(*keys).applyInArrow(run, schema).collect(), key=lambda r: r["_no"]):
        found.setdefault(tuple(r[c] for c in keys), []).append(np.frombuffer(r["_data"], np.float32).reshape(-1, r["_columns"]))
    return found


def fit_codebooks(vectors: DataFrame, sizes: dict, filed: dict, *, most_copies: int, kept_copies: int, list_rows: int, most_lists: int, sample_rows: int, parts: int, seed: int, rounds: int = 8) -> dict:
    """A codebook for each (model, revision, dimension), fitted in tasks on samples of distinct vectors.

    A space has a list for each ``list_rows`` of its ``filed`` rows. Its cells, about the root
    of that number, are fitted on at most about ``sample_rows`` vectors, and then the lists of
    every cell on the sample's vectors in it (16 a list), as many as its share of the rows asks
    for, so that dense regions have more. All books hold at most about ``most_lists`` centroids,
    a list's size in bytes times that, which bounds the broadcast; beyond ``most_lists x
    list_rows`` vectors lists grow instead.
    """
    total = sum(filed.values())
    lists = {key: max(1, min(n // list_rows, most_lists * n // total)) for key, n in filed.items()}
    every = sum(d for _, d in sizes.values())
    least = max(64, min(4096, sample_rows // len(sizes)))
    first = {key: max(sample_rows * d // every, least) for key, (_, d) in sizes.items()}
    wanted = {key: max(n, 16 * lists[key]) for key, n in first.items()}
    sample = sample_vectors(vectors, sizes, wanted, seed, most_copies, kept_copies)
    drawn = {(r["_space"], r["_width"]): r["n"] for r in sample.groupBy("_space", "_width").agg(F.sum("_n").alias("n")).collect()}

    def part_of(rows: dict) -> Column:
        return F.coalesce(*[F.when((F.col("_space") == s) & (F.col("_width") == w), F.col("_place") < n / wanted[s, w]) for (s, w), n in rows.items()])

    def rng(key: dict) -> np.random.Generator:
        return np.random.default_rng(seed)

    def cells(key: dict, rows: np.ndarray, _) -> list[np.ndarray]:
        return [_kmeans(rows, min(int(np.ceil(np.sqrt(lists[key["_space"], key["_width"]]))), len(rows)), rounds, rng(key), True)]

    top = {key: found[0] for key, found in _fitted(sample.where(part_of(first)), ["_space", "_width"], cells).items()}
    known = vectors.sparkSession.sparkContext.broadcast(top)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces, widths = np.array(batch.column("_space").to_pylist(), object), batch.column("_width").to_numpy()
            for name, width in sorted(set(zip(spaces, widths.tolist()))):
                some = batch.take(pa.array(np.flatnonzero((spaces == name) & (widths == width))))
                cell = _closest(_unit(_matrix(some.column("vector"), width).astype(np.float32)), known.value[name, width], True)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32))], names=[*some.schema.names, "_cell"])

    def inside(key: dict, rows: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
        space = key["_space"], key["_width"]
        share = int(copies.sum()) / drawn[space]
        return [_kmeans(rows, int(np.clip(round(share * lists[space]), 1, max(1, len(rows) // 4))), rounds, rng(key), True)]

    in_cells = sample.mapInArrow(placed, "_space string, _width int, vector array<float>, _place double, _n long, _cell int")
    leaves = _fitted(in_cells, ["_space", "_width", "_cell"], inside)
    books = {}
    for (name, width), centres in top.items():
        own = [leaves.get((name, width, i), [centres[i : i + 1]])[0] for i in range(len(centres))]
        books[name, width] = Codebook(centres, own)
    coarse = vectors.sparkSession.sparkContext.broadcast(books)

    def fine(key: dict, rows: np.ndarray, _) -> list[np.ndarray]:
        book = coarse.value[key["_space"], key["_width"]]
        residual = rows - book.lists[book.nearest(rows, 1)[0][:, 0]]
        edges = np.linspace(0, key["_width"], min(parts, key["_width"]) + 1).astype(int)
        return [_kmeans(np.ascontiguousarray(residual[:, a:b]), min(256, len(rows)), rounds, rng(key), False) for a, b in zip(edges, edges[1:])]

    few = {key: min(n, 16384) for key, n in first.items()}
    for key, made in _fitted(sample.where(part_of(few)), ["_space", "_width"], fine).items():
        books[key].fine = made
    return books


def nearest_neighbours(
    vectors: DataFrame,
    *,
    k: int = 5,
    least: float = -1.0,
    list_rows: int = 64,
    most_lists: int = 262144,
    sample_rows: int = 16384,
    spread: int = 6,
    slack: float = 0.15,
    depth: int = 96,
    parts: int = 32,
    seed: int = 11,
) -> DataFrame:
    """For each chunk_id of each (model, revision): its ``k`` most similar others, by cosine.

    Input: embedding_model, embedding_revision, embedding_dimension, chunk_id, vector,
    created_at; ``latest_vectors`` says which rows count. Output: embedding_model,
    embedding_revision, chunk_id, neighbour_id, similarity (cosine in double precision rounded
    to 12 decimals), only of at least ``least``; ties go to the smaller neighbour_id.

    Every vector is filed in the inverted list of its nearest coarse centroid and in up to
    ``spread - 1`` further lists that are nearly as close, and asks in all of them: two
    neighbours meet if they share any list, not only if one is in the other's first. That
    matters the more, the more lists there are, since a vector that is near no centroid has
    many equally far from it. Lists are small, so that small groups get centroids of their own.
    A list is scored by distance tables over product-quantised residuals and the best ``depth``
    are reranked exactly (all where there are no more); of the answers of several lists the
    best ``k`` count. The number of lists grows with that of the vectors, so a list, which is
    one task's group, stays at about ``list_rows`` of its own and twice that of its neighbours'.
    Vectors travel to their lists whole, since the exact rerank needs them there: a list's
    members are few, while fetching ``depth`` candidates for each query would move many times
    the table. Of a vector's copies in a list only the ``k + 1`` smallest ids are scored, so
    that copies cannot fill the ``depth`` candidates.

    A vector with more copies than a thousandth of all rows is indexed by the ``k + 1``
    smallest ids of its copies, which are all that can be among anyone's first ``k``; the other
    copies take the answer of the last of those, which is theirs too. There are fewer than a
    thousand such vectors, so their hashes may reach the driver; else only centroids do.

    A null model or revision counts as an empty name. An empty table gives no rows; repeated
    rows count once; columns other than the named ones are ignored.
    """
    spark = vectors.sparkSession
    keys = ["embedding_model", "embedding_revision", "chunk_id"]
    named = vectors.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in keys[:2]], "chunk_id", "embedding_dimension", "created_at", F.col("vector").cast("array<float>").alias("vector")
    )
    fitted = named.where(usable(F.col("vector"), F.col("embedding_dimension")))
    answer = "embedding_model string, embedding_revision string, chunk_id string, neighbour_id string, similarity double"
    sizes = space_sizes(fitted)
    if not sizes:
        return spark.createDataFrame([], answer)
    one = latest_vectors(named)
    look = F.xxhash64(*keys[:2], "vector")
    most_copies = max(k + 1, sum(n for n, _ in sizes.values()) // 1000)
    counted = fitted.groupBy(look.alias("_look"), _space().alias("_space"), F.size("vector").alias("_width")).agg(F.count("*").alias("n"))
    many = counted.where(F.col("n") > most_copies).collect()
    hot, filing = [r["_look"] for r in many], {key: n for key, (n, _) in sizes.items()}
    for r in many:
        filing[r["_space"], r["_width"]] -= r["n"] - (k + 1)
    books = fit_codebooks(
        fitted, sizes, filing, most_copies=most_copies, kept_copies=k + 1, list_rows=list_rows, most_lists=most_lists, sample_rows=sample_rows, parts=parts, seed=seed
    )
    shared = spark.sparkContext.broadcast(books)
    given, others = one, None
    if hot:
        copies = one.withColumn("_look", look).where(F.col("_look").isin(hot))
        # the k + 1 smallest ids, by salted parts first so that no task sorts a hot group
        salted = W.partitionBy("_look", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).orderBy("chunk_id")
        few = copies.select("_look", "chunk_id", F.row_number().over(salted).alias("_r")).where(F.col("_r") <= k + 1)
        few = few.select("_look", "chunk_id", F.row_number().over(W.partitionBy("_look").orderBy("chunk_id")).alias("_r")).where(F.col("_r") <= k + 1)
        others = copies.join(few.select("_look", "chunk_id"), ["_look", "chunk_id"], "left_anti").select(*keys, "_look")
        last = few.groupBy("_look").agg(F.max("chunk_id").alias("_last"))
        given = one.withColumn("_look", look).where(~F.col("_look").isin(hot)).unionByName(copies.join(few.select("_look", "chunk_id"), ["_look", "chunk_id"], "left_semi")).drop("_look")
    filed = given.mapInArrow(_file(shared, spread, slack), "embedding_model string, embedding_revision string, chunk_id string, vector array<float>, _list int, _role int")
    found = filed.groupBy(*keys[:2], "_list", F.size("vector").alias("_width")).applyInArrow(_search(shared, k, depth, least), f"{answer}, _role int")
    found = _merged(settle(found, "answers"), k)  # frees the filed vectors before answers are shuffled
    if others is not None:
        theirs = found.join(last, found["chunk_id"] == last["_last"]).select("_look", *keys[:2], "neighbour_id", "similarity")
        found = found.unionByName(others.join(theirs, ["_look", *keys[:2]]).select(*found.columns))
    return found


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs chunk_id_a < chunk_id_b of which one is among the other's neighbours."""
    return found.select(
        "embedding_model", "embedding_revision", F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")
    ).distinct()
