"""Near duplicates among vectors: spherical k-means cells, blocked cosine products inside them, one row kept of each group.

Equal vectors are one class. Cells are those of the centroids of a bounded sample; every vector has its nearest one as
home. Two vectors of cosine t stand at the angle a = arccos(t), so a vector is compared in another cell only if that cell's
region, the meeting of half spaces, comes within a of it, and in only one of both homes: no link is lost, wherever the borders lie.
Vectors within a / 2 of their centroid (the core of a cell) all link with each other, so a dense group of any size is
counted, not compared. All others meet in tiles of bounded size, whose products are taken at once; a tile hands on
counts and one edge for each linked vector, never pairs.
"""

from __future__ import annotations

from hashlib import blake2b
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import bounded_batches, cut, packed, small, unpacked
from scriptorium.llm.components import components

THRESHOLD = 0.95
#: Classes for each cell, and the most cells.
CELL, MOST_CELLS = 8_192, 1_024
#: Classes (those of the smallest digests) and bytes of the sample that the centroids are fitted on, and rounds of k-means.
SAMPLE, SAMPLE_BYTES, ROUNDS = 16_384, 1 << 26, 8
#: Rows and components of either side of a tile, and rows compared at once.
TILE, TILE_VALUES, STRIP = 8_192, 1 << 20, 256
#: Of bounds in double precision, of products in single precision, and how near to the threshold cosines are summed anew.
SLACK, ROUGH, NEAR = 1e-9, 1e-4, 1e-9


def _read(lists: pa.Array, single: bool) -> list[bytes | None]:
    """The components of each vector as little-endian floats; nothing for nulls, zeros, and null or non-finite components."""
    lists = lists.cast(pa.list_(pa.float64()))
    ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    values = lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
    bad, full = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
    fit = (bad[ends] == bad[starts]) & (full[ends] > full[starts])
    size = 4 if single else 8
    data = values.astype("<f4" if single else "<f8").tobytes()
    return [data[size * s : size * e] if ok else None for s, e, ok in zip(starts.tolist(), ends.tolist(), fit.tolist())]


def _matrix(vectors: list[bytes], single: bool) -> np.ndarray:
    """Vectors of one length as rows, scaled by powers of two so that squares neither overflow nor vanish."""
    raw = np.frombuffer(b"".join(vectors), "<f4" if single else "<f8").astype(float).reshape(len(vectors), -1)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """In double precision, from sums that are rounded once: the same in whatever tile two vectors meet."""
    return fsum(x * y) / sqrt(fsum(x * x) * fsum(y * y))


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length by spherical k-means; first ones are drawn far from each other, so a dense group of any
    size gets few. The draw is fixed by the sample."""
    chance = np.random.default_rng(20_240_229)
    chosen = [0]
    far = 1 - sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        weight = np.cumsum(np.maximum(far, 0.0) ** 2)
        if weight[-1] <= 1e-9:
            break
        chosen.append(int(np.searchsorted(weight, chance.random() * weight[-1], side="right").clip(0, len(sample) - 1)))
        far = np.minimum(far, 1 - sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        fine = size > 1e-9
        centres = np.where(fine[:, None], sums / np.where(fine, size, 1.0)[:, None], centres)
    return centres


def place(rows: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home bucket, buckets that a link may lead to) of unit vectors. Bucket 2c is the core of cell c, 2c + 1 its rest.

    For all x of cell c and any mean m of centroids, x·(m - c) <= 0; so y with y·(m - c) / |m - c| > sin(a) is more than
    a away from all of them. The means tried are those of the 1, 2 and 4 centroids nearest to y.
    """
    width = centres.shape[1]
    rows = rows[:, :width] if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    near, between = rows @ centres.T, centres @ centres.T
    home = near.argmax(axis=1)
    angle, most = np.arccos(np.clip(near, -1, 1)), np.arccos(threshold)
    core = angle[np.arange(len(rows)), home] <= most / 2 - 1e-6
    reach = np.ones(near.shape, bool)
    order = np.argsort(-near, axis=1, kind="stable")[:, :4]
    for m in {1, min(2, len(centres)), min(4, len(centres))}:
        top = order[:, :m]
        mean_near = np.take_along_axis(near, top, 1).mean(axis=1)
        to_all = between[top].mean(axis=1)
        own = np.take_along_axis(to_all, top, 1).mean(axis=1)
        apart = np.sqrt(np.maximum(own[:, None] - 2 * to_all + 1, 0))
        reach &= (mean_near[:, None] - near) <= (np.sin(most) + SLACK) * apart + SLACK
    reach[np.arange(len(rows)), home] = True
    buckets = np.empty((len(rows), 2 * len(centres)), bool)
    buckets[:, 0::2] = reach & (angle <= 1.5 * most + 1e-6)
    buckets[:, 1::2] = reach
    return 2 * home + ~core, buckets


def _placed(table: pa.RecordBatch, single: bool, centres: np.ndarray, threshold: float) -> pa.RecordBatch:
    """`table` with its home and visits: of two buckets that may hold a link, the one of the higher number visits the other."""
    vectors = table.column("vector").to_pylist()
    home, visits = [0] * len(vectors), [[] for _ in vectors]
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(vectors):
        by_size.setdefault(len(x), []).append(i)
    for at in by_size.values():
        for k in range(0, len(at), 1_024):
            some = at[k : k + 1_024]
            own, may = place(_unit(_matrix([vectors[i] for i in some], single)), centres, threshold)
            may &= np.arange(may.shape[1]) < own[:, None]
            for i, h, v in zip(some, own.tolist(), may):
                home[i], visits[i] = h, np.flatnonzero(v).tolist()
    return pa.RecordBatch.from_arrays([*table.columns, pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=[*table.schema.names, "home", "visits"])


def _links(left: np.ndarray, right: np.ndarray, threshold: float):
    """(rows of left, rows of right, which of these link) strip by strip: rough products first, exact ones where they ask."""
    one, other = _unit(left), _unit(right)
    rough = other.astype(np.float32).T.copy()
    for at in range(0, len(left), STRIP):
        maybe = one[at : at + STRIP].astype(np.float32) @ rough >= threshold - ROUGH
        a, b = np.flatnonzero(maybe.any(axis=1)) + at, np.flatnonzero(maybe.any(axis=0))
        if not len(a):
            continue
        exact = one[a] @ other[b].T
        linked = exact >= threshold
        for i, j in zip(*np.nonzero(np.abs(exact - threshold) < NEAR)):
            linked[i, j] = cosine(left[a[i]], right[b[j]]) >= threshold
        yield a, b, linked


def compare(tile: pa.Table, single: bool, threshold: float) -> pa.Table:
    """For each class of a tile with links in it: how many rows it links with, and the first class that it hangs together with.

    Side 0 is compared with side 1, or with itself where there is no other side."""
    tile = tile.sort_by("digest")
    side, weight = tile.column("side").to_numpy(), tile.column("weight").to_numpy()
    vectors = tile.column("vector").to_pylist()
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = bool((tile.column("j").to_numpy() == tile.column("i").to_numpy()).all())
    links, root = np.zeros(len(side), np.int64), np.arange(len(side))
    if len(first) and (alone or len(second)):
        left = _matrix([vectors[i] for i in first], single)
        right = left if alone else _matrix([vectors[i] for i in second], single)
        second = first if alone else second
        for a, b, linked in _links(left, right, threshold):
            if alone:
                linked &= a[:, None] != b[None, :]
            np.add.at(links, first[a], linked @ weight[second[b]])
            if not alone:
                np.add.at(links, second[b], weight[first[a]] @ linked)
            for i, row in zip(a[linked.any(axis=1)], linked[linked.any(axis=1)]):
                found = np.append(root[second[b[row]]], root[first[i]])
                least = found.min()
                if (found != least).any():
                    root[np.isin(root, found)] = least
    at = np.flatnonzero(links)
    return pa.table({"digest": tile.column("digest").take(pa.array(at)), "links": pa.array(links[at]), "root": tile.column("digest").take(pa.array(root[at]))})


def _tiles(placed: DataFrame, rows: int) -> DataFrame:
    """A row for each tile that a class takes part in: parts i and j of a bucket's own rows, or part i and visitors -1 - j."""
    part = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    visits = placed.withColumn("bucket", F.explode("visits"))
    own = placed.groupBy("size", F.col("home").alias("bucket")).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    guests = visits.groupBy("size", "bucket").agg(F.ceil(F.count("*") / rows).cast("int").alias("guests"))
    sizes = small(cut(own.join(guests, ["size", "bucket"], "left").fillna(0, ["guests"])), 100_000)
    columns = ["size", "bucket", "digest", "weight", "vector"]
    tile = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    at_home = placed.withColumn("bucket", F.col("home")).join(sizes, ["size", "bucket"]).withColumn("a", part(F.col("parts")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "a").alias("i"), F.greatest(x, "a").alias("j"), (F.col("a") > x).cast("int").alias("side")))
    hosts = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda x: tile(F.col("a"), -1 - x, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    pairs = F.when(F.col("bucket") % 2 == 1, pairs).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    at_home = at_home.select(*columns, F.inline(F.concat(pairs, hosts)))
    away = visits.join(sizes, ["size", "bucket"]).withColumn("b", part(F.col("guests")))
    away = away.select(*columns, F.inline(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: tile(x, -1 - F.col("b"), 1))))
    return at_home.unionByName(away)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", cell: int = CELL, tile: int = TILE) -> DataFrame:
    """(row, n_links, component_id, kept) for each row of `vectors`, in `row` with all its columns.

    n_links counts the other rows at a cosine of `threshold` (above 0) or more, component_id is the smallest id that links lead to,
    itself included; kept says that it is the row's own. Vectors that are null, empty or zero, or hold null or non-finite components, and
    rows without an id link with nothing and are kept; so do vectors of different lengths with each other. Repeated rows
    are rows of their own, which link with each other and share an id, so all of one id may be kept. Cosines within 1e-9
    of the threshold are summed exactly. An empty table gives an empty table. Work grows with the number of rows whose cells lie within the angle, which for
    vectors without any clusters is most of them.
    """
    source = vectors.schema[vector].dataType
    single = isinstance(source, T.ArrayType) and isinstance(source.elementType, T.FloatType)

    @F.arrow_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("vector", T.BinaryType())]))
    def read(lists: pa.Array) -> pa.Array:
        found = _read(lists, single)
        return pa.StructArray.from_arrays([pa.array([x and blake2b(x, digest_size=16).digest() for x in found], pa.binary()), pa.array(found, pa.binary())], ["digest", "vector"])

    rows = packed(bounded_batches(vectors)).withColumn("id", F.col("row").getField(vec_id)).withColumn("own", read(F.col("row").getField(vector)))
    rows = rows.select("row", "id", F.when(F.col("id").isNotNull(), F.col("own.digest")).alias("digest"), F.col("own.vector").alias("vector"))
    named = rows.where("digest is not null")
    classes = cut(named.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector")).withColumn("size", F.octet_length("vector")))
    seen = classes.agg(F.count("*").alias("n"), F.max("size").alias("bytes")).first()
    n, width = seen["n"], (seen["bytes"] or 8) // (4 if single else 8)
    wanted = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    below = min((wanted << 32) // max(n, 1), (1 << 32) - 1)
    sample = classes.where(F.col("digest") <= F.lit(bytearray(below.to_bytes(4, "big") + b"\xff" * 12))).orderBy("digest").select("vector")
    some = [_unit(_matrix([r["vector"]], single))[0] for r in sample.limit(2 * wanted).collect()]
    known = np.zeros((max(len(some), 1), width))
    for i, x in enumerate(some):
        known[i, : len(x)] = x
    centres = fit(known, max(1, min(MOST_CELLS, -(-n // cell), len(known) // 8)))
    cast = vectors.sparkSession.sparkContext.broadcast(centres)

    def placing(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                yield _placed(batch.slice(at, 4_096), single, cast.value, threshold)

    placed = cut(classes.select("digest", "weight", "vector", "size").mapInArrow(placing, "digest binary, weight long, vector binary, size int, home int, visits array<int>"))
    tiles = _tiles(placed, max(64, min(tile, TILE_VALUES // width)))
    met = tiles.groupBy("size", "bucket", "i", "j").applyInArrow(lambda t: compare(t, single, threshold), "digest binary, links long, root binary")
    core = placed.where("home % 2 = 0")
    cores = core.groupBy("size", "home").agg(F.sum("weight").alias("all"), F.min("digest").alias("root"))
    dense = core.join(small(cores, 100_000), ["size", "home"]).select("digest", (F.col("all") - F.col("weight")).alias("links"), "root")
    equal = classes.where("weight > 1").select("digest", (F.col("weight") - 1).alias("links"), F.col("digest").alias("root"))
    found = cut(met.unionByName(dense).unionByName(equal).where("links > 0"))
    linked = found.groupBy("digest").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("digest"), "root")
    table = cut(classes.select("digest", "id").join(linked, "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")))
    least = table.groupBy("root").agg(F.min("id").alias("component_id"))
    answers = table.join(least, "root").select("digest", "n_links", "component_id")
    judged = named.join(answers, "digest", "left").select("row", "id", "n_links", "component_id")
    idle = rows.where("digest is null").select("row", "id", F.lit(None).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = judged.unionByName(idle).withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", "id")})
    return every.select("row", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that near_duplicates() keeps: that of the smallest id of each group, and all that link with nothing."""
    found = near_duplicates(vectors, threshold, vec_id, vector)
    return found.where("kept").select(*unpacked(vectors, vectors.columns))
