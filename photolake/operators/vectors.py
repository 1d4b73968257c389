"""Neighbours of embeddings within a distance, and clusters of faces."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photolake.operators.graph import connected_components
from photolake.session import cut, stored


def _unit(column: pd.Series) -> np.ndarray:
    v = np.stack(column.to_numpy()).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


@dataclass(frozen=True)
class Cells:
    """An index: centres of cells on the unit sphere, how many of them a search asks, and the recall measured with that."""

    centres: np.ndarray
    probes: int
    recall: float

    def asked(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own cell, and whether it asks each cell: the ``probes`` nearest."""
        near = -(v @ self.centres.T)
        home, probes = near.argmin(axis=1), min(self.probes, near.shape[1])
        mask = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(mask, np.argpartition(near, probes - 1, axis=1)[:, :probes], True, axis=1)
        mask[np.arange(len(v)), home] = True
        return home, mask


#: Lloyd rounds, and at most so many vectors that they and the measured searches see.
ROUNDS, SAMPLE, MEASURED = 10, 100_000, 256


def lists(n: int) -> int:
    """Cells for ``n`` vectors: the power of two next above their root, so a cell has about the root of them."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, math.sqrt(n)))))


def fit_cells(vectors: DataFrame, max_distance: float, k: int, recall: float = 0.9, cells: int | None = None) -> Cells:
    """Cells fitted to a sample of ``vectors`` (id, embedding) by Lloyd rounds, and the fewest probes that reach ``recall``.

    The sample is the first ``SAMPLE`` vectors by a hash of the id. Recall is measured: of
    ``MEASURED`` vectors, others by another hash, the ``k`` nearest within the distance are
    searched exactly among all vectors, and a neighbour counts as found if its cell is
    asked. Data without clusters need many probes for one distance, data with clusters
    few; the measured share is kept. Without any neighbour one probe is enough.
    """
    rows = vectors.where("embedding IS NOT NULL AND id IS NOT NULL").select("id", "embedding")
    n = cells or lists(rows.count())
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(sample):
        return Cells(np.ones((1, 1)), 1, 1.0)
    v = _unit(sample["embedding"])
    centres = v[:n].copy()
    for _ in range(ROUNDS):
        home = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(v, max(1, len(v) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    asked = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(MEASURED)
    found = nearest(asked, rows, k + 1).where(F.col("query") != F.col("id")).where(F.col("distance") <= max_distance)
    pairs = found.join(rows, "id").join(asked.select(F.col("id").alias("query"), F.col("embedding").alias("q")), "query").select("q", "embedding").toPandas()
    if not len(pairs):
        return Cells(centres, 1, 1.0)
    there = (_unit(pairs["embedding"]) @ centres.T).argmax(axis=1)
    near = _unit(pairs["q"]) @ centres.T
    rank = np.sort((near > near[np.arange(len(there)), there][:, None]).sum(axis=1))
    probes = int(rank[min(len(rank) - 1, math.ceil(recall * len(rank)) - 1)]) + 1
    return Cells(centres, probes, float((rank < probes).mean()))


def _tiles(vectors: DataFrame, max_distance: float, keys: tuple[str, ...], cells: int, block: int, extra: tuple[str, ...] = (), index: Cells | None = None) -> DataFrame:
    """``(*keys, id, embedding, *extra, cell, block, asker, asks)``: every vector as a member of its cell and as an asker of the cells it may have neighbours in.

    Cells are those of ``cells`` centres at most, as many as the root of the number of
    vectors, taken from the data. A member y of cell c is on c's side of the plane
    between c and x's own centre h, and x is (|x - c|^2 - |x - h|^2) / (2 |c - h|) from
    it, so x asks c only if that is within the distance. Members and askers of one key
    and cell are each split by a hash into blocks of about ``block``, counted for each
    cell, so neither is ever collected whole, however many vectors are alike.
    """
    spark = vectors.sparkSession
    rows = vectors.select(*keys, "id", "embedding", *extra).where("embedding IS NOT NULL AND id IS NOT NULL")
    n = 1 if index else int(min(cells, max(1, math.isqrt(rows.count()))))
    picked = rows.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(2 * n).toPandas()
    sampled = _unit(picked["embedding"]) if len(picked) else np.zeros((0, 1))
    # chord on the unit sphere of the cosine distance
    chord = float(np.sqrt(2 * max(max_distance, 0.0))) + 1e-9

    def reached(v: np.ndarray, c: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own cell, and whether it asks each cell."""
        d2 = (v * v).sum(axis=1)[:, None] + 1 - 2 * v @ c.T
        home = d2.argmin(axis=1)
        return home, d2 - d2.min(axis=1, keepdims=True) <= 2 * chord * between[home] + 1e-9

    def apart(c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))

    chosen = sampled[:n]
    # where most cells would be asked, cells only copy vectors: one is left, and blocks alone part the work
    if len(sampled) > n and reached(sampled[n:], chosen, apart(chosen))[1].mean() > 0.5:
        chosen = sampled[:1]
    centres = spark.sparkContext.broadcast(index or chosen)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centres.value
        between = None if isinstance(c, Cells) else apart(c)
        for pdf in batches:
            if len(pdf):
                home, asked = c.asked(_unit(pdf["embedding"])) if between is None else reached(_unit(pdf["embedding"]), c, between)
                yield pdf.assign(cell=home, asked=[np.flatnonzero(x) for x in asked])

    assigned = stored(rows.mapInPandas(assign, f"{rows.schema.simpleString()[7:-1]}, cell long, asked array<long>"), "vectors")
    by = [*keys, "cell"]
    members = assigned.drop("asked")
    asks = assigned.withColumn("cell", F.explode("asked")).drop("asked")
    sizes = members.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # a cell without members of the key is not asked
    asking = asks.select(*by).join(sizes, by).groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("askers"), F.first("blocks").alias("blocks"))

    def hashed(of: str):
        return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    names = [*keys, "id", "embedding", *extra, "cell"]
    left = asks.join(asking, by).select(*names, hashed("askers").alias("asker"), F.lit(True).alias("asks"), every("blocks").alias("block"))
    right = members.join(asking, by).select(*names, hashed("blocks").alias("block"), F.lit(False).alias("asks"), every("askers").alias("asker"))
    return left.unionByName(right)


def _by_tile(tiles: DataFrame, keys: tuple[str, ...]):
    return tiles.groupBy(*keys, "cell", "block", "asker")


def _sides(tile: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A tile's askers and members."""
    asks = tile["asks"].to_numpy(dtype=bool)
    return tile[asks], tile[~asks]


def _distances(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Askers in parts and their cosine distances to all members."""
    if len(left) and len(right):
        members = _unit(right["embedding"])
        for a in range(0, len(left), 1024):
            part = left.iloc[a : a + 1024]
            yield part, 1 - _unit(part["embedding"]) @ members.T


def neighbours(
    vectors: DataFrame,
    max_distance: float,
    k: int | None = None,
    keys: tuple[str, ...] = (),
    with_self: bool = False,
    cells: int = 4096,
    block: int = 4096,
    since: str | None = None,
    until: str | None = None,
    index: Cells | None = None,
) -> DataFrame:
    """``(*keys, id, other, distance)``: all others of the same keys within a cosine distance, the nearest ``k`` of each.

    Exact, or with an ``index`` of ``fit_cells`` with its recall; see ``_tiles``. How many cells a vector asks hangs on the distance: a few at
    0.01, and on data without clusters all of its key's at 0.5 and more, where no exact
    search can leave any out. Taking the nearest k and then the threshold is the same as
    the reverse. Zero vectors are at distance 1 from all.

    With columns ``since`` and ``until`` a vector is only found by those whose ``until``
    is not before its ``since``, as faces of a person in photos since their birth. A
    vector without ``since`` is found by all; one without ``until`` finds only such.
    """
    tiles = _tiles(vectors, max_distance, keys, cells, block, (since, until) if since and until else (), index)
    id_kind = tiles.schema["id"].dataType.simpleString()

    def search(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(tile)
        out = [pd.DataFrame({"id": [], "other": [], "distance": []})]
        ids = right["id"].to_numpy()
        for part, d in _distances(left, right):
            near = d <= max_distance + 1e-12
            if since and until:
                near &= right[since].isna().to_numpy() | (part[until].to_numpy()[:, None] >= right[since].to_numpy())
            i, j = np.nonzero(near)
            found = pd.DataFrame({"id": part["id"].to_numpy()[i], "other": ids[j], "distance": d[i, j]})
            found = found if with_self else found[found["id"] != found["other"]]
            if k is not None:
                found = found.sort_values(["id", "distance", "other"]).groupby("id", sort=False).head(k)
            out.append(found)
        got = pd.concat(out[1:] or out)
        for name, value in zip(keys, key):
            got[name] = value
        return got[[*keys, "id", "other", "distance"]]

    kinds = ", ".join(f"{x} {tiles.schema[x].dataType.simpleString()}" for x in keys)
    found = _by_tile(tiles, keys).applyInPandas(search, f"{kinds + ', ' if kinds else ''}id {id_kind}, other {id_kind}, distance double")
    if k is None:
        return found
    rank = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("distance", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _top(ids: np.ndarray, q: np.ndarray, pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    d = 1 - q @ _unit(pdf["embedding"]).T
    top = np.argsort(d, axis=1, kind="stable")[:, :k]
    return pd.DataFrame({"query": np.repeat(ids, top.shape[1]), "id": pdf["id"].to_numpy()[top.ravel()], "distance": np.take_along_axis(d, top, axis=1).ravel()})


def nearest(queries: DataFrame, vectors: DataFrame, k: int, most: int = 1000, block: int = 16384) -> DataFrame:
    """``(query, id, distance, rank)``: the ``k`` vectors closest to each query by cosine distance, then id.

    Up to ``most`` queries travel with the tasks, and every batch keeps its own best k
    before anything is shuffled. More are dealt by a hash into blocks of about that
    size; each meets every block of about ``block`` vectors in a group of its own.
    """
    asked, rows = queries.select("id", "embedding"), vectors.select("id", "embedding")
    few = asked.orderBy("id").limit(most + 1).toPandas()
    schema = "query long, id long, distance double"
    if len(few) <= most:
        shared = queries.sparkSession.sparkContext.broadcast((few["id"].to_numpy(), _unit(few["embedding"]) if len(few) else None))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for pdf in batches:
                if len(pdf) and len(ids):
                    yield _top(ids, q, pdf, k)

        found = rows.mapInPandas(best, schema)
    else:
        asks, parts = -(-asked.count() // most), max(1, -(-rows.count() // block))
        left = asked.withColumn("ask", F.pmod(F.xxhash64("id"), F.lit(asks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
        right = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1)).cast("array<bigint>")))

        def meet(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
            if not len(one) or not len(other):
                return pd.DataFrame({"query": [], "id": [], "distance": []})
            return _top(one["id"].to_numpy(), _unit(one["embedding"]), other, k)

        found = left.groupBy("ask", "part").cogroup(right.groupBy("ask", "part")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def distances(query: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(id, distance)``: every vector's cosine distance to the one ``query``; nothing is shuffled."""
    q = query.select("embedding").toPandas()
    shared = query.sparkSession.sparkContext.broadcast(_unit(q["embedding"]) if len(q) else None)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and shared.value is not None:
                d = 1 - shared.value @ _unit(pdf["embedding"]).T
                yield pd.DataFrame({"id": np.tile(pdf["id"].to_numpy(), len(d)), "distance": d.ravel()})

    return vectors.select("id", "embedding").mapInPandas(apply, "id long, distance double")


def cluster_faces(faces: DataFrame, max_distance: float = 0.5, min_faces: int = 3, keys: tuple[str, ...] = (), may_be_core: str | None = None) -> DataFrame:
    """``(*keys, id, person)``: faces joined to people by density.

    A face with at least ``min_faces`` faces within the distance (itself counts) is a
    core, if the column ``may_be_core``, where one is named, is true; cores within the distance are one person, named by the smallest core. Other
    faces join the person of their nearest core in reach, the smallest id of equals, or
    none (null), whatever the order. No pairs are written: first every tile counts, then
    it gives one edge for each two groups that it joins (see ``_tiles``).
    """
    tiles = stored(_tiles(faces, max_distance, keys, 4096, 4096), "face-tiles")
    kind = tiles.schema["id"].dataType.simpleString()

    def count(tile: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(tile)
        got = [pd.DataFrame({"id": part["id"].to_numpy(), "n": (d <= max_distance + 1e-12).sum(axis=1)}) for part, d in _distances(left, right)]
        return pd.concat(got) if got else pd.DataFrame({"id": [], "n": []})

    counts = _by_tile(tiles, keys).applyInPandas(count, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
    cores = counts.where(F.col("n") >= min_faces).select("id")
    if may_be_core:
        cores = cores.join(faces.where(may_be_core).select("id"), "id", "left_semi")
    cores = cut(cores)

    def join(tile: pd.DataFrame) -> pd.DataFrame:
        """Core to core: edges that join what the tile joins, at most as many as it has faces. Others: their nearest core of the tile."""
        left, right = _sides(tile)
        right = right[right["core"]]
        ids, face_ids, others, reach, flags = right["id"].to_numpy(), [], [], [], []
        label = np.arange(len(ids))
        for part, d in _distances(left, right):
            for face, core, row in zip(part["id"].to_numpy(), part["core"].to_numpy(), d):
                near = np.flatnonzero(row <= max_distance + 1e-12)
                if not len(near):
                    continue
                if core:
                    groups, first = np.unique(label[near], return_index=True)
                    pick = near[first]
                    label[np.isin(label, groups)] = groups[0]
                else:
                    pick = near[[np.lexsort((ids[near], row[near]))[0]]]
                face_ids += [face] * len(pick)
                others += ids[pick].tolist()
                reach += row[pick].tolist()
                flags += [bool(core)] * len(pick)
        return pd.DataFrame({"id": face_ids, "other": others, "distance": reach, "core": pd.Series(flags, dtype=bool)})

    flagged = tiles.join(cores.withColumn("core", F.lit(True)), "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    found = stored(_by_tile(flagged, keys).applyInPandas(join, f"id {kind}, other {kind}, distance double, core boolean"), "face-links")
    person = connected_components(found.where("core").select(F.col("id").alias("src"), F.col("other").alias("dst"))).select(F.col("node").alias("other"), F.col("component").alias("person"))
    of_others = found.where("NOT core").join(person, "other").groupBy("id").agg(F.min_by("person", F.struct("distance", "other")).alias("person"))
    of_cores = person.withColumnRenamed("other", "id")
    return faces.select(*keys, "id").join(of_cores.unionByName(of_others), "id", "left")
