"""Nearest neighbours by an inverted multi-index.

Two codebooks quantise the two halves of a vector; a cell is a pair of
centroids, and there are about n / ``CELL`` of them. A heap yields a query's
cells by the sum of the two squared distances until they hold ``FIRST`` entries.
The last sum, a measure of how dense the data are there, times a stretch is the
query's reach. Only entries of cells within reach are compared with it, exactly.

Nothing that grows with the data is broadcast but the codebooks, which grow
with its square root: the sizes of cells are a table that the yielded cells are
joined with. Entries are laid out in bundles of neighbouring cells, and a query
is sent once to each bundle that it reaches. Equal vectors are one entry with
their least ids, so copies, however many, cost one comparison.

The stretch is calibrated: for about ``CALIBRATION`` vectors the true neighbours
are found among all entries, and the stretch is the least with which the share
``TARGET`` of them is within reach.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, few

NEIGHBOURS = 10
#: Entries of a cell, on average.
CELL = 32
#: The documented bound on the vectors that the codebooks are fitted on, those of the least id hashes; fewer for small codebooks.
SAMPLE, LEAST_SAMPLE, PER_CENTROID = 1 << 18, 4096, 16
CALIBRATION, TARGET = 256, 0.97
#: Entries that the heap finds before reach is stretched, and cells that it yields in the first round.
FIRST, WALK = 32, 64
#: Entries of a bundle, and queries compared with one copy of it.
BUNDLE, QUERIES = 8192, 8192
#: In the registered query, ids that this divides are queries.
EVERY = 100


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` from all of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _lloyd(x: np.ndarray, k: int, passes: int = 8) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(np.float64)
    for _ in range(passes):
        total, n = np.zeros_like(c), np.zeros(k, np.int64)
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            label = _distances(part, c.astype(np.float32)).argmin(1)
            np.add.at(total, label, part)
            n += np.bincount(label, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c.astype(np.float32)


class MultiIndex:
    """The two codebooks and the layout of cells in bundles."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = first, second
        self.half, self.dim = first.shape[1], first.shape[1] + second.shape[1]
        self.shape = len(first), len(second)

    @staticmethod
    def fit(x: np.ndarray, k: int) -> MultiIndex:
        half = x.shape[1] // 2
        return MultiIndex(_lloyd(x[:, :half], k), _lloyd(x[:, half:], k))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the two halves from their centroids."""
        return tuple(_distances(x[:, s], b).astype(np.float64) for s, b in zip((slice(0, self.half), slice(self.half, None)), self.books, strict=True))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * self.shape[1] + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int]]:
        """(sum, cell) of one query's cells by their sums, lazily: the heap holds a cell of each row that was begun."""
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db, width = a[order_a], b[order_b], self.shape[1]
        heap = [(da[0] + db[0], 0, 0)]
        while heap:
            total, i, j = heapq.heappop(heap)
            yield float(total), int(order_a[i]) * width + int(order_b[j])
            # (i, j) is pushed by its left neighbour, and column 0 by the one above: each pair once.
            if j + 1 < len(db):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(da):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))

    def lay_out(self, rows: np.ndarray) -> None:
        """Bundles of about ``BUNDLE`` entries, from the entries of each first centroid: several rows, or a part of one."""
        self.bundle, self.parts, now, held = np.zeros(self.shape[0], np.int64), np.ones(self.shape[0], np.int64), 0, 0
        for i, n in enumerate(rows):
            if held and held + n > BUNDLE:
                now, held = now + 1, 0
            self.bundle[i] = now
            self.parts[i] = max(1, min(self.shape[1], -(-int(n) // BUNDLE)))
            if self.parts[i] > 1:
                now, held = now + int(self.parts[i]), 0
            else:
                held += int(n)

    def bundle_of(self, cell: np.ndarray) -> np.ndarray:
        i, j = np.divmod(cell, self.shape[1])
        return self.bundle[i] + j * self.parts[i] // self.shape[1]

    def visits(self, a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
        """The bundles with a cell within a query's reach."""
        rows = np.flatnonzero(a + b.min() <= reach)
        one = self.parts[rows] == 1
        out = [self.bundle[rows[one]]]
        for i in rows[~one]:
            near = np.flatnonzero(a[i] + b <= reach)
            out.append(self.bundle[i] + near * self.parts[i] // self.shape[1])
        return np.unique(np.concatenate(out))


#: Pairs that are compared in double precision at a time.
EXACT = 1 << 17


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, cells: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, distance) positions of each query's ``k`` nearest entries, ties by id.

    ``cells`` limits the comparisons to some cells: (starts of each cell's
    entries in ``x`` and their end, a function from a slice of queries to which
    cells each visits). Single precision only chooses whom to compare: all within
    its error of the k-th, so that equal distances, however many, are ordered by id.
    """
    left, right, value = [], [], []
    longest = float((x * x).sum(1).max()) if len(x) else 0.0
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        if cells is None:
            d = _distances(part, x)
        else:
            starts, allowed = cells
            d = np.full((len(part), len(x)), np.inf, np.float32)
            see = allowed(at, at + 256)
            for c in np.flatnonzero(see.any(0)):
                mine, lo, hi = np.flatnonzero(see[:, c]), starts[c], starts[c + 1]
                d[mine, lo:hi] = _distances(part[mine], x[lo:hi])
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(part), np.inf, np.float32)
        limit = limit + 4e-6 * ((part * part).sum(1) + longest)
        near = (d <= limit[:, None]) & np.isfinite(d)
        bounds, i = np.concatenate([[0], np.cumsum(near.sum(1))]), 0
        while i < len(part):
            stop = max(i + 1, int(np.searchsorted(bounds, bounds[i] + EXACT, "right")) - 1)
            row, entry = np.nonzero(near[i:stop])
            exact = ((x[entry].astype(np.float64) - part[i:stop][row].astype(np.float64)) ** 2).sum(1)
            best = np.lexsort((ids[entry], exact, row))
            first = bounds[i:stop] - bounds[i]
            best = best[np.arange(len(row)) - first[row] < k]  # lexsort keeps the rows' places
            left.append(row[best] + at + i)
            right.append(entry[best])
            value.append(exact[best])
            i = stop
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right), np.concatenate(value)) if left else (empty, empty, np.zeros(0))


def _clean(table: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(id, v, h, g)`` of the usable rows, one a vec_id, and the vectors' length; (h, g) is a vector's key."""
    v = F.col("embedding").cast("array<float>")
    good = table.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = good.groupBy(F.size("v").alias("d")).count().where("d > 1").orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    good = good.where(F.size("v") == dim)
    # Only ids are shuffled to find repeated ones; vectors are if some are.
    again = scratch.write(good.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    n = again.count()
    if n:
        small = few(again, n)
        good = good.join(small, "id", "left_anti").unionByName(good.join(small, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))
    return good.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}), dim


KEY = ["h", "g"]


def _chosen(part: float) -> Column:
    """Which keys are in a hash sample of about this part of all."""
    return F.pmod(F.xxhash64(F.lit(2), "h"), F.lit(1 << 30)) < F.lit(int(min(1.0, part) * (1 << 30)))


def neighbours(table: DataFrame, k: int = NEIGHBOURS, target: float = TARGET, every: int | None = None) -> DataFrame:
    """``(vec_id, neighbour_id, distance, rank)``: the ``k`` nearest other vectors of each, by squared Euclidean distance.

    All rows are entries. All are queries too, or those whose vec_id ``every``
    divides. Equal distances rank by neighbour_id. The mean recall is about
    ``target``; what is found is exact.

    * Rows with a null vec_id or embedding, a null, NaN or infinite component,
      or another length than most rows have no part (lengths under two either).
    * Rows that repeat a vec_id are one; the least embedding counts.
    * Repeated embeddings under other ids are neighbours at distance 0.
    * With fewer than ``k`` other vectors all are given; none for empty tables.
    * Other columns aren't read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    good, dim = _clean(table, scratch)
    vectors = scratch.write(good, "vectors")
    order = Window.partitionBy(*KEY).orderBy("id")
    # The limit is applied before the shuffle as well, so a vector with many copies moves a few of them.
    least = vectors.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    entries = scratch.write(least.groupBy(*KEY).agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, distance double, rank int")
    wanted_centroids = max(1, round(math.sqrt(n / CELL)))
    size = min(SAMPLE, max(LEAST_SAMPLE, PER_CENTROID * wanted_centroids))
    sample = entries.where(_chosen(size / n)).select("v", *KEY).orderBy(*KEY).toArrow()  # about `size` rows
    x = _matrix(sample.column("v"), dim) if sample.num_rows else _matrix(entries.limit(1).toArrow().column("v"), dim)
    index = MultiIndex.fit(x, int(min(wanted_centroids, max(1, len(x) // PER_CENTROID))))
    shared = spark.sparkContext.broadcast(index)  # two books of sqrt(n / CELL) halves, SAMPLE / PER_CENTROID at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.cells(_matrix(batch.column("v"), dim)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["h", "g", "v", "ids", "cell"])

    placed = scratch.write(entries.select("h", "g", "v", "ids").mapInArrow(place, "h long, g long, v array<float>, ids array<long>, cell long"), "placed")
    scratch.drop("entries")
    directory = scratch.write(placed.groupBy("cell").agg(F.count("*").alias("n")), "directory")
    rows = np.zeros(index.shape[0], np.int64)
    for r in directory.groupBy(F.floor(F.col("cell") / index.shape[1]).alias("row")).agg(F.sum("n").alias("n")).collect():  # a row a centroid
        rows[r["row"]] = r["n"]
    index.lay_out(rows)
    stretch = _calibrate(placed, index, k, target, n)
    asked = vectors if every is None else vectors.where(F.col("id") % every == 0)
    queries = scratch.write(asked.groupBy(*KEY).agg(F.first("v").alias("v")), "queries")
    reached = _reach(scratch, queries, directory, index, stretch)
    found = scratch.write(_search(spark, scratch, placed, directory, reached, index, k + 1), "found")
    scratch.drop("placed", "queries")
    # Each query's own id is left out of its list of k + 1.
    near = F.slice(F.filter("near", lambda s: s["id"] != F.col("id")), 1, k)
    lists = asked.select("id", *KEY).join(found, KEY).select("id", F.posexplode(near).alias("place", "s"))
    return lists.select(F.col("id").alias("vec_id"), F.col("s.id").alias("neighbour_id"), F.col("s.distance").alias("distance"), (F.col("place") + 1).cast("int").alias("rank"))


def _calibrate(placed: DataFrame, index: MultiIndex, k: int, target: float, n: int) -> float:
    """The stretch with which the share ``target`` of the sample's true neighbours is within reach; one scan of all entries."""
    spark = placed.sparkSession
    got = placed.where(_chosen(CALIBRATION / n)).select("h", "v").orderBy("h").toArrow()  # about CALIBRATION rows
    if not got.num_rows:
        return 1e30
    q = _matrix(got.column("v"), index.dim)
    shared = spark.sparkContext.broadcast((index, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch a query's nearest entries with the sums of their cells, and the ``FIRST`` least sums of all."""
        index, q = shared.value
        near, far = index.halves(q)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, d = nearest(q, _matrix(batch.column("v"), index.dim), batch.column("h").to_numpy(), k + 1)
            row, column = np.divmod(batch.column("cell").to_numpy(), index.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(d), batch.column("h").take(pa.array(b)), pa.array(near[a, row[b]] + far[a, column[b]])], names=["q", "d", "h", "total"])
            for i in range(len(q)):
                least = near[i, row] + far[i, column]
                least = np.partition(least, FIRST - 1)[:FIRST] if len(least) > FIRST else least
                size = len(least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, i)), pa.nulls(size, pa.float64()), pa.nulls(size, pa.int64()), pa.array(least)], names=["q", "d", "h", "total"])

    both = placed.select("h", "v", "cell").mapInArrow(run, "q long, d double, h long, total double")
    order = Window.partitionBy("q", F.col("d").isNull()).orderBy("d", "total", "h")
    most = F.when(F.col("d").isNull(), FIRST).otherwise(k + 1)
    best = both.withColumn("r", F.row_number().over(order)).where((F.col("r") <= max(FIRST, k + 1)) & (F.col("r") <= most)).select("q", "d", "total").toPandas()
    first = best[best["d"].isna()].groupby("q")["total"].max()
    true = best[best["d"] > 0]  # the query itself is at distance 0
    stretch = (true["total"] / np.maximum(first.reindex(true["q"]).to_numpy(), 1e-30)).to_numpy()
    return float(max(1.0, np.quantile(stretch, target, method="higher"))) if len(stretch) else 1e30


def _reach(scratch: Scratch, queries: DataFrame, directory: DataFrame, index: MultiIndex, stretch: float) -> DataFrame:
    """``(h, g, v, reach)``: ``stretch`` times the sum of the cell in which a query's heap finds its ``FIRST``-th entry.

    A round takes a number of cells of each query's walk and joins them with the
    sizes of cells; queries that need more go on to a round of four times as many.
    """
    spark, cells = queries.sparkSession, index.shape[0] * index.shape[1]
    shared = spark.sparkContext.broadcast(index)
    sizes = few(directory, directory.count())
    take, todo, done, turn = int(min(cells, WALK)), queries, [], 0
    while True:
        turn += 1

        def walk(batches: Iterator[pa.RecordBatch], take=take) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                a, b = index.halves(_matrix(batch.column("v"), index.dim))
                for i in range(batch.num_rows):
                    yielded = [y for _, y in zip(range(take), index.walk(a[i], b[i]), strict=False)]
                    size = len(yielded)
                    columns = [pa.array(np.full(size, batch.column(c)[i].as_py())) for c in range(2)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(size)), pa.array([s for s, _ in yielded]), pa.array([c for _, c in yielded])], names=["h", "g", "at", "total", "cell"])

        steps = todo.select("h", "g", "v").mapInArrow(walk, "h long, g long, at long, total double, cell long").join(sizes, "cell")
        so_far = F.sum("n").over(Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        own = steps.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < FIRST).groupBy(*KEY).agg(F.max("total").alias("first"), F.sum("n").alias("seen"))
        own = scratch.write(own, f"reach-{turn}")
        if take >= cells:
            done.append(own)
            break
        done.append(own.where(F.col("seen") >= FIRST))
        todo = scratch.write(todo.join(done[-1], KEY, "left_anti"), f"todo-{turn}")
        if todo.isEmpty():
            break
        take = min(cells, take * 4)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return queries.join(out.select(*KEY, (F.col("first") * F.lit(stretch)).alias("reach")), KEY)


def _search(spark: SparkSession, scratch: Scratch, placed: DataFrame, directory: DataFrame, queries: DataFrame, index: MultiIndex, k: int) -> DataFrame:
    """``(h, g, near)``: the ``k`` nearest ids of each query, itself among them, as structs of distance and id."""
    shared = spark.sparkContext.broadcast(index)

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.bundle_of(batch.column("cell").to_numpy()))], names=["v", "ids", "cell", "piece", "bundle"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            a, b = index.halves(_matrix(batch.column("v"), index.dim))
            # Sums are computed again in another order; the slack is over their rounding.
            limit = batch.column("reach").to_numpy() + 1e-5 * (1 + batch.column("reach").to_numpy())
            visits = [index.visits(x, y, z) for x, y, z in zip(a, b, limit, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("g"), batch.column("v"), pa.array(limit), pa.array(visits, pa.list_(pa.int64()))], names=["h", "g", "v", "reach", "bundles"])

    # A cell of more than two bundles is cut into pieces by the entries' hashes; few cells are.
    large = scratch.write(directory.where(F.col("n") > 2 * BUNDLE).select("cell", F.ceil(F.col("n") / BUNDLE).alias("pieces")), "large")
    count = large.count()
    entries = placed.select("h", "v", "ids", "cell")
    if count:
        entries = entries.join(few(large, count), "cell", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("h"), F.col("pieces")), F.lit(0)).cast("long"))
    else:
        entries = entries.withColumn("piece", F.lit(0).cast("long"))
    entries = entries.select("v", "ids", "cell", "piece").mapInArrow(bundles, "v array<float>, ids array<long>, cell long, piece long, bundle long")
    sent = scratch.write(queries.select("h", "g", "v", "reach").mapInArrow(visit, "h long, g long, v array<float>, reach double, bundles array<long>"), "sent").select("h", "g", "v", "reach", F.explode("bundles").alias("bundle"))
    groups = sent.groupBy("bundle").agg(F.ceil(F.count("*") / QUERIES).alias("salts"))
    if count:
        cut = large.select("cell", "pieces").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(shared.value.bundle_of(b.column("cell").to_numpy())), b.column("pieces")], names=["bundle", "pieces"]) for b in it), "bundle long, pieces long").groupBy("bundle").agg(F.max("pieces").alias("pieces"))
        groups = groups.join(cut, "bundle", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    else:
        groups = groups.withColumn("pieces", F.lit(1).cast("long"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    sent = sent.join(groups, "bundle").withColumn("salt", F.pmod(F.xxhash64("h"), F.col("salts"))).withColumn("piece", upto("pieces")).drop("salts", "pieces")
    copies = entries.join(groups, "bundle").withColumn("salt", upto("salts")).drop("salts", "pieces")
    by = ["bundle", "piece", "salt"]
    found = copies.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(comparison(index.shape, shared, k), "h long, g long, distance double, ids array<long>")
    order = Window.partitionBy(*KEY).orderBy("distance", F.col("ids")[0])
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return best.select(*KEY, "distance", F.explode("ids").alias("id")).groupBy(*KEY).agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, k).alias("near"))


def comparison(shape: tuple[int, int], shared, k: int):
    """The function that compares a bundle's entries with the queries sent to it."""

    def compare(entries: pa.Table, queries: pa.Table) -> pa.Table:
        index = shared.value
        if not entries.num_rows or not queries.num_rows:
            return pa.table({"h": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        entries = entries.take(pa.array(np.argsort(entries.column("cell").to_numpy(), kind="stable")))
        x, lists, cell = _matrix(entries.column("v"), index.dim), entries.column("ids").combine_chunks(), entries.column("cell").to_numpy()
        q, limit = _matrix(queries.column("v"), index.dim), queries.column("reach").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        row, column = np.divmod(cell[starts], shape[1])

        def allowed(lo: int, hi: int) -> np.ndarray:
            a, b = index.halves(q[lo:hi])
            return a[:, row] + b[:, column] <= limit[lo:hi, None]

        first = lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]
        a, b, d = nearest(q, x, first, k, (np.append(starts, len(x)), allowed))
        pick = pa.array(a)
        return pa.table({"h": queries.column("h").take(pick), "g": queries.column("g").take(pick), "distance": pa.array(d), "ids": lists.take(pa.array(b))})

    return compare
