"""N-gram Jaccard self-join: all pairs of texts whose sets of five-word shingles are alike by 0.8 or more.

1. Texts with equal shingle sets are copies; one of each class of copies, with its number, stands for all.
2. MinHash bands group the representatives; groups that share one are joined into candidate components.
3. Inside a component, pairs are compared hash by hash: the matches among the first n MinHash values give a posterior
   (uniform prior, so a beta distribution) of the pair's likeness, and the pair is dropped as soon as the probability
   of reaching the threshold falls below a tolerance. What remains is verified exactly on the shingle sets.
4. A large component is dealt out in blocks, and each pair of blocks is a task of its own, which gets those texts that
   share a band with the other block; a task returns for each text the number of its links and one edge to the least
   text of its local class, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, cut, packed, q, small, unpacked
from scriptorium.llm.components import components
from scriptorium.llm.hashing import U64, mixed, word_hashes

WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares none of 32 bands of 6 values with probability 6e-5; one alike by 0.9 with 3e-11.
BANDS, ROWS = 32, 6
#: Values compared before each look at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 24, 1e-6
#: Texts of one block; a task compares two blocks at most.
BLOCK = 512
#: Rows up to which a side is broadcast (16 to 40 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 400_000
#: Bands of large components up to this number are broadcast, each with its at most a few blocks.
BROADCAST_BANDS = 50_000
#: Shingles laid side by side in one step of the exact check.
IDS_AT_ONCE = 1_000_000

def _odd(n: int) -> np.ndarray:
    """n odd multipliers from a fixed splitmix sequence."""
    out, x = [], 0x1234567
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, U64)


MULTIPLIERS = _odd(BANDS * ROWS)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer than k words, one shingle of all of them."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    wide = min(k, len(hashes))
    grams = np.full(len(hashes) - wide + 1, wide, U64)
    for i in range(wide):
        grams = grams * U64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - wide + 1 + i]
    return np.unique(mixed(grams))


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    least = np.full(len(MULTIPLIERS), np.iinfo(U64).max, U64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (MULTIPLIERS[:, None] * grams[None, at : at + 2048]).min(axis=1), out=least)
    return (least >> U64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    rows = values.reshape(BANDS, ROWS).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for r in range(ROWS):
        key = mixed(key * U64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def least_matches(steps: list[int], threshold: float, tolerance: float) -> list[int]:
    """For each n of `steps`, the fewest matches at which P(likeness >= threshold | matches of n) isn't below `tolerance`.

    With a uniform prior the posterior is beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in steps:
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append(m)
                break
        else:
            out.append(n)
    return out


def _described(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """doc_id, digest of the shingle set, node (a 64-bit part of it) and band keys."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys, nodes, bands = [], [], []
            for text in part.column(1).to_pylist():
                grams = shingles(text, k)
                if not len(grams):
                    keys.append(None), nodes.append(None), bands.append(None)
                    continue
                key = xxhash.xxh3_128_digest(grams.tobytes())
                keys.append(key)
                nodes.append(int.from_bytes(key[:8], "little", signed=True))
                bands.append(band_keys(signature(grams)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "node", "bands"])


def _gathered(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """node, shingle set and signature of texts that have candidates."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            nodes, sets, values = [], [], []
            for text in batch.slice(at, 256).column(0).to_pylist():
                grams = shingles(text, k)
                if len(grams):
                    nodes.append(int.from_bytes(xxhash.xxh3_128_digest(grams.tobytes())[:8], "little", signed=True))
                    sets.append(grams.tobytes()), values.append(signature(grams).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(values, pa.binary())], names=["node", "grams", "values"])


def _linked(sets: list[np.ndarray], values: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, tolerance: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j that it is linked with), each pair once: pairs inside `left`, or between `left` and `right`."""
    steps = list(range(STEP, values.shape[1] + 1, STEP))
    fewest = least_matches(steps, threshold, tolerance)
    sizes = np.array([len(s) for s in sets])
    terms, place = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = [place[bounds[i] : bounds[i + 1]] for i in range(len(sets))]
    here = np.zeros(len(terms), bool)
    for at, i in enumerate(left):
        rest = left[at + 1 :] if right is None else right
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i]) - 1e-9]
        matches = np.zeros(len(rest), np.int32)
        for n, m in zip(steps, fewest):
            if not len(rest):
                break
            matches = matches + (values[rest, n - STEP : n] == values[i, n - STEP : n]).sum(axis=1)
            rest, matches = rest[matches >= m], matches[matches >= m]
        if not len(rest):
            continue
        here[ids[i]] = True
        parts = np.split(rest, np.flatnonzero(np.diff(np.cumsum(sizes[rest]) // IDS_AT_ONCE)) + 1)
        common = np.concatenate([np.add.reduceat(here[np.concatenate([ids[j] for j in part])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]])) for part in parts])
        here[ids[i]] = False
        alike = common >= threshold * (sizes[i] + sizes[rest] - common) - 1e-9
        if alike.any():
            yield int(i), rest[alike]


def _compared(group: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame:
    """Links of each text in the block pairs of one task, and an edge to the least text of its local class."""
    out = []
    for (_, low, high), cell in group.groupby(["root", "low", "high"], sort=False):
        cell = cell.drop_duplicates("node").reset_index(drop=True)
        nodes, copies = cell["node"].to_numpy(), cell["copies"].to_numpy()
        sets = [np.frombuffer(x, U64) for x in cell["grams"]]
        values = np.frombuffer(b"".join(cell["values"]), np.uint32).reshape(len(cell), -1)
        left = np.flatnonzero(cell["block"].to_numpy() == low)
        right = None if low == high else np.flatnonzero(cell["block"].to_numpy() == high)
        links, parent = np.zeros(len(cell), np.int64), list(range(len(cell)))

        def top(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, others in _linked(sets, values, left, right, threshold, tolerance):
            links[i] += copies[others].sum()
            links[others] += copies[i]
            for j in others.tolist():
                a, b = top(i), top(j)
                if a != b:
                    parent[a] = b
        linked = np.flatnonzero(links)
        if len(linked):
            tops = np.array([top(int(x)) for x in linked])
            hubs = pd.Series(nodes[linked]).groupby(tops).transform("min").to_numpy()
            out.append(pd.DataFrame({"node": nodes[linked], "hub": hubs, "links": links[linked]}))
    return pd.concat(out) if out else pd.DataFrame({"node": pd.Series(dtype="int64"), "hub": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})


def _candidates(copies: DataFrame) -> DataFrame:
    """(node, root) of representatives that share a band with another one."""
    bands = copies.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    return components(bands.join(small(shared, BROADCAST_ROWS), "band").select(F.col("node").alias("u"), F.col("hub").alias("v")))


def _dealt(copies: DataFrame, members: DataFrame) -> DataFrame:
    """`members` with their own block and each other block that has a text with which they share a band.

    So a text is sent to as many tasks as blocks hold candidates for it, however large its component is: once in a
    component of one block, and in a long chain of weakly alike texts hardly more often than it has candidates.
    """
    placed = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = placed.where("blocks > 1")
    bands = cut(copies.select("node", F.explode("bands").alias("band")).join(large.select("node", "root", "block"), "node"))
    seen = cut(bands.groupBy("band").agg(F.sort_array(F.collect_set("block")).alias("others")))
    others = bands.join(small(seen, BROADCAST_BANDS), "band").select("node", F.explode("others").alias("other")).distinct()
    dealt = large.join(others, "node").select(*placed.columns, "other")
    return placed.where("blocks = 1").withColumn("other", F.col("block")).unionByName(dealt)


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id, n_links and n_copies.

    class_id is the smallest doc_id of all documents that links of `threshold` or more hang together; n_links is the
    number of other documents linked with this one, copies among them; n_copies of them have the same shingle set.
    Null and empty texts have no shingles: they are linked with nothing and are classes of their own. Fewer words than
    k make one shingle. Rows with the same id are documents of their own. Long texts count whole. Other columns are not looked at, and an
    empty table gives an empty table.
    """
    return _joined(docs, text, doc_id, k, threshold, tolerance, block).select("doc_id", "class_id", "n_links", "n_copies")


def _joined(docs: DataFrame, text: str, doc_id: str, k: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """join() with the digest of each row's shingle set (key) and, where it has links, a number of its class (root)."""
    rows = bounded_batches(docs).select(q(doc_id).alias("doc_id"), q(text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    described = cut(rows.mapInArrow(lambda b: _described(b, k), f"doc_id {id_type}, key binary, node long, bands array<long>"))
    copies = described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("node").alias("node"), F.first("bands").alias("bands"))
    copies = cut(copies)
    light = copies.select("node", "rep", "copies")
    roots = cut(_candidates(copies))

    sizes = roots.groupBy("root").agg(F.count("*").alias("m")).select(F.col("root").alias("r"), F.ceil(F.col("m") / block).cast("int").alias("blocks"), "m")
    members = cut(roots.join(sizes, F.col("root") == F.col("r")).join(light, "node").select("node", "root", "blocks", "rep", "copies"))
    groups = max(1, members.count() // (2 * block))
    wanted = members.select(F.col("rep").alias("wanted")).distinct()
    texts = rows.join(small(wanted, BROADCAST_ROWS), rows["doc_id"].eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = texts.mapInArrow(lambda b: _gathered(b, k), "node long, grams binary, values binary")
    dealt = _dealt(copies, members)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.xxhash64("root", low, high))
    tasks = dealt.select("node", "copies", "root", "block", low.alias("low"), high.alias("high"), cell.alias("cell")).join(sets, "node")
    compared = cut(tasks.groupBy("cell").applyInPandas(lambda g: _compared(g, threshold, tolerance), "node long, hub long, links long"))

    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    hubs = components(compared.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    classed = hubs.join(links, "node").join(light, "node").select("root", "node", "links", "rep")
    classes = classed.groupBy("root").agg(F.min("rep").alias("class"))
    near = classed.join(classes, "root").select("node", "root", "class", "links")
    told = copies.select("key", "node", "rep", "copies").join(near, "node", "left").where("copies > 1 or links is not null")
    told = told.select(F.col("key").alias("of"), F.coalesce("root", "node").alias("root"), F.coalesce("class", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), (F.col("copies") - 1).alias("n_copies"))
    return described.join(small(cut(told), BROADCAST_ROWS), F.col("key") == F.col("of"), "left").select(
        "doc_id",
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"),
        "key",
        "root",
    )


def _key_of(k: int):
    """The digest of a text's shingle set, as join() takes it; null without shingles."""

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        grams = (shingles(t, k) for t in texts)
        return pd.Series([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in grams], dtype=object)

    return key


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, in their own columns, without all but one of each class: one of its smallest id.

    An id that no other row has tells its row. Rows of repeated ids and without an id are told by their shingle sets
    too, so each is judged by its own class; of rows with the class's smallest id, one of the least set stays. Texts without
    words, null ones among them, all stay; an empty table gives an empty table, and columns of any name stay the caller's.
    """
    classes = cut(_joined(docs, text, doc_id, k, threshold, tolerance, block))
    linked = classes.where("n_links > 0")
    shared = classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_links").alias("most")).where("most > 0 and (n > 1 or doc_id is null)")
    shared = small(cut(shared.select(F.col("doc_id").alias("shared"))), BROADCAST_ROWS)
    gone = linked.where("not (doc_id <=> class_id)").select(F.col("doc_id").alias("gone")).distinct()
    rows = packed(docs).withColumn("_id", F.col("row").getField(doc_id))
    single = rows.join(shared, F.col("_id").eqNullSafe(F.col("shared")), "left_anti").join(small(gone, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("gone")), "left_anti")

    known = linked.join(shared, F.col("doc_id").eqNullSafe(F.col("shared")), "left_semi")
    least = known.where("doc_id <=> class_id").groupBy("root").agg(F.min("key").alias("stays"))
    marks = known.groupBy("doc_id", "class_id", "root", "key").agg(F.count("*").alias("n")).join(least, "root", "left")
    marks = cut(marks.select(F.col("doc_id").alias("of"), "key", F.coalesce(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("stays")), F.lit(False)).alias("stays")))
    again = rows.join(shared, F.col("_id").eqNullSafe(F.col("shared")), "left_semi").withColumn("_key", _key_of(k)(F.col("row").getField(text).cast("string")))
    told = again.join(small(marks, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("of")) & (F.col("_key") == F.col("key")), "left")
    firsts = told.where("stays").groupBy("_id", "_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.select("row").unionByName(told.where("stays is null").select("row")).unionByName(firsts.select("row")).select(*unpacked(docs, docs.columns))
