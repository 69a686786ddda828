"""What is to be read, copied, sent or done: canon by tiers, ingest decisions, copy plans, the delta with a remote store, batches."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import is_canon, match_name
from scriptorium.llm.components import components
from scriptorium.operators.dedup import saved
from scriptorium.operators.state import queue

NO_TIER = 99
#: Code points by which the ends of words are looked up.
HEAD = 4
#: Fixed value: file types that a remote store takes.
REMOTE_TYPES = [".md", ".markdown", ".txt"]


def tier_of(path: Column, bases: list[tuple[int, str]]) -> Column:
    """The tier of the first base folder that a path lies in; 99 outside of all."""
    found = F.lit(NO_TIER)
    for tier, base in reversed(bases):
        root = base.rstrip("/")
        found = F.when((path == root) | F.startswith(path, F.lit(root + "/")), tier).otherwise(found)
    return found


def canon_folders(tiers: list[tuple[int, str]], last_only: bool) -> list[tuple[int, str]]:
    """The tiers' folders in their order, or the first tier's alone."""
    return [t for t in tiers if t[0] == 1] if last_only else tiers


def canon(files: DataFrame, roots: list[str], tiers: list[tuple[int, str]], canonical: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """Canonical files with their tier: below a root, and in a folder SOT, marked by their front matter, or of a canonical
    root. A file below several roots counts once. Order them by tier and lower(path)."""
    name = F.col(path)
    below = lambda r: F.startswith(name, F.lit(r.rstrip("/") + "/"))
    whole = reduce(lambda a, b: a | b, [below(r) for r in roots if r.rstrip("/").rsplit("/", 1)[-1] in canonical], F.lit(False))
    under = reduce(lambda a, b: a | b, [below(r) for r in roots], F.lit(False))
    chosen = files.where(under & (F.contains(name, F.lit("/SOT/")) | is_canon(F.col(text)) | whole))
    return chosen.dropDuplicates([path]).withColumn("tier", tier_of(name, tiers))


def canon_parts(files: DataFrame, rel: str = "rel", text: str = "text") -> DataFrame:
    """rel, tier and part of canonical files: their text under a line with tier and path; files without text are left out."""
    head = F.concat(F.lit("### SOT Tier "), F.col("tier").cast("string"), F.lit(": "), F.col(rel), F.lit("\n\n"))
    return files.where(F.col(text).isNotNull()).select(rel, "tier", F.concat(head, F.col(text)).alias("part"))


def decisions(files: DataFrame, manifest: DataFrame, similar: DataFrame, completed: DataFrame) -> DataFrame:
    """name, md5, status and duplicate_of of each file (name, md5): what an ingest does with it.

    skipped: another name has its md5, in the manifest (name, md5) or earlier by name; duplicate: it is like an earlier
    file (similar: name, duplicate_of); completed: its outputs are there (completed: name); else pending. Owners of
    digests are minima, so a digest that a third of all files share is one row of each task.
    """
    known = manifest.groupBy("md5").agg(F.min("name").alias("known"))
    firsts = files.groupBy("md5").agg(F.min("name").alias("first"))
    owners = firsts.join(known, "md5", "left").select("md5", F.coalesce("known", "first").alias("owner"))
    rows = files.join(owners, "md5", "left").join(similar.select("name", "duplicate_of"), "name", "left").join(completed.select("name").distinct().withColumn("done", F.lit(True)), "name", "left")
    other = F.coalesce(F.col("owner") != F.col("name"), F.lit(False))
    like = F.col("duplicate_of").isNotNull() & (F.col("duplicate_of") != F.col("name"))
    status = F.when(other, "skipped").when(like, "duplicate").when(F.col("done"), "completed").otherwise("pending")
    return rows.select("name", "md5", status.alias("status"), F.when(other, F.col("owner")).when(like, F.col("duplicate_of")).alias("duplicate_of"))


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries after new ones are put in: rows (root, new, place, name, md5, status), entries of a root first, then its new ones in their order.

    Of each name and digest the places are kept, the first at hand; those that have got another one since are passed over."""
    there, places, last = {}, {}, None

    def first(side: int, key: str) -> int | None:
        found = places.get((side, key), [])
        while found and there[found[0]][side] != key:
            heapq.heappop(found)
        return found[0] if found else None

    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [()] * 4, [pa.int64(), *[pa.string()] * 3])], names=["place", "name", "md5", "status"])

    for batch in batches:
        done = []
        for root, new, place, *entry in zip(*(c.to_pylist() for c in batch.columns)):
            if root != last:
                done += [(at, *x) for at, x in there.items()]
                there, places, last = {}, {}, root
            keys = [(side, key) for side, key in enumerate(entry[:2]) if key is not None]
            at = min((x for x in (first(*k) for k in keys) if x is not None), default=place) if new else place
            there[at] = entry
            for k in keys:
                heapq.heappush(places.setdefault(k, []), at)
        yield rows(done)
    yield rows([(at, *x) for at, x in there.items()])


def registered_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (place, name, md5, status) after new ones (name, md5, status) have been put in, one by one in order of name.

    Each renews the first entry that has its name or its digest at that time, else it is added after the last place, by
    its own order. Only rows that hang together by names and digests can change what another one finds, so these are the components of
    a graph, whose rounds grow with the logarithm of the longest chain; inside of one, rows are taken in turn, in sorted partitions. Memory is that of one
    component. Repeated rows of `new` are one.
    """
    order = ["name", "md5", "status"]
    files = ordered(new.select(*order).distinct(), order, "ord")
    last = entries.agg(F.max("place").alias("p")).first()["p"]
    base = -1 if last is None else last
    own = entries.select(F.lit(False).alias("new"), F.col("place").cast("long").alias("place"), *order)
    rows = saved(own.unionByName(files.select(F.lit(True).alias("new"), (F.col("ord") + base).alias("place"), *order)))
    key = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), c))
    rows = rows.withColumns({"u": key("name"), "v": key("md5")})
    roots = components(rows.where("u is not null and v is not null").select("u", "v"))
    node = F.coalesce("u", "v", F.xxhash64(F.lit("place"), "place"))
    placed = rows.withColumn("node", node).join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "new", "place", *order)
    return placed.repartition("root").sortWithinPartitions("root", "new", "place").mapInArrow(_in_turn, "place long, name string, md5 string, status string")


def ordered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """`rows` numbered from 1 in their order: range partitions, a count for each, and a number inside each."""
    parts = saved(rows.repartitionByRange(*by)).withColumn("_part", F.spark_partition_id())
    offsets, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(part), F.lit(total)]
        total += n
    if not offsets:
        return rows.withColumn(name, F.lit(0).cast("long"))
    return parts.withColumn(name, (F.row_number().over(Window.partitionBy("_part").orderBy(*by)) + F.create_map(*offsets)[F.col("_part")]).cast("long")).drop("_part")


def copy_plan(sources: DataFrame, there: DataFrame, manifest: DataFrame) -> DataFrame:
    """label, key and action (skip or copy) of each source file (label, rel, size, md5).

    A file is skipped if the target (key, size, md5) has one of its size under label/rel, whose digest by the manifest
    (key, md5) or itself is the same.
    """
    jobs = sources.withColumn("key", F.concat_ws("/", "label", "rel"))
    own = there.select("key", F.col("size").alias("had_size"), F.col("md5").alias("had_md5"))
    noted = manifest.groupBy("key").agg(F.max("md5").alias("noted"))
    both = jobs.join(own, "key", "left").join(noted, "key", "left")
    same = (F.col("had_size") == F.col("size")) & (F.coalesce(F.col("noted") == F.col("md5"), F.lit(False)) | F.coalesce(F.col("had_md5") == F.col("md5"), F.lit(False)))
    return both.select("label", "key", "md5", "size", F.when(F.coalesce(same, F.lit(False)), "skip").otherwise("copy").alias("action"))


def after_copy(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """The manifest (key, md5) with what a plan copies."""
    new = plan.where("action = 'copy'").select("key", "md5")
    return manifest.join(new, "key", "left_anti").select("key", "md5").unionByName(new)


def uploaded_entry(raw: Column) -> Column:
    """A cache entry of either form, an object with location and md5 or a bare location, as a struct of both."""
    value = F.from_json(raw, "location string, md5 string")
    is_object = F.startswith(F.ltrim(raw), F.lit("{"))
    return F.struct(F.coalesce(F.when(is_object, value["location"]).otherwise(raw), F.lit("")).alias("location"), F.coalesce(F.when(is_object, value["md5"]), F.lit("")).alias("md5"))


def in_store(files: DataFrame, keys: DataFrame, rel: str = "rel") -> DataFrame:
    """The files (rel) that a store's keys name: by the same key, or a key that contains rel, its last part or its stem.

    A name that stands in a key leaves its words there, the first perhaps as the end of a longer word and the last as the
    start of one. So each file asks by the word of its stem that the fewest files have, for the ends of the keys' words
    that begin with it; only those pairs are compared. A stem without any word is looked up in the keys' runs between words.
    """
    norm = lambda x: F.replace(x, F.lit("\\"), F.lit("/"))
    words = lambda x: F.array_distinct(F.filter(F.split(x, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    tail = F.element_at(F.split(norm(F.col(rel)), "/"), -1)
    stem = match_name(F.regexp_replace(tail, r"(?<=.)\.[^.]*$", ""))
    asked = files.select(rel, norm(F.col(rel)).alias("whole"), tail.alias("tail"), stem.alias("stem")).distinct()
    own = asked.select(rel, F.explode(words(F.col("stem"))).alias("w"))
    common = own.groupBy("w").agg(F.count("*").alias("n"))
    rarest = own.join(common, "w").groupBy(rel).agg(F.min(F.struct("n", (-F.length("w")).alias("l"), "w")).alias("x")).select(rel, "x.w")
    told = keys.select(norm(F.col("key")).alias("key")).distinct()
    ends = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.length(x)))
    tokens = told.select("key", F.explode(words(match_name(F.col("key")))).alias("v")).select("key", F.explode(ends(F.col("v"))).alias("end"))
    heads = tokens.select("key", "end", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("end"))), lambda n: F.substring("end", F.lit(1), n)))).alias("h"))
    found = asked.join(rarest, rel).withColumn("h", F.substring("w", 1, HEAD)).join(heads, "h").where(F.startswith("end", F.col("w")))
    fits = F.contains("key", F.col("whole")) | F.contains("key", F.col("tail")) | F.contains(match_name(F.col("key")), F.col("stem"))
    # a stem without letters and digits is in a key if it is in one of its runs of such characters, of which there are few kinds
    bare = asked.join(rarest, rel, "left_anti")
    gaps = told.select(F.explode(F.filter(F.split(match_name(F.col("key")), r"[\p{L}\p{N}]+"), lambda w: w != "")).alias("v")).distinct()
    gaps = gaps.select("v", F.explode(ends(F.col("v"))).alias("end")).select("end").distinct()
    starts = gaps.select("end", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("end"))), lambda n: F.substring("end", F.lit(1), n)))).alias("h"))
    bare = bare.where("stem <> ''").withColumn("h", F.substring("stem", 1, HEAD)).join(starts, "h").where(F.startswith("end", F.col("stem")))
    return found.where(fits).select(rel).unionByName(bare.select(rel)).distinct()


def remote_delta(files: DataFrame, cache: DataFrame, keys: DataFrame, force: bool = False, manual: bool = True) -> DataFrame:
    """rel, md5, action and location of each file (rel, md5) of a type that the store takes.

    cached: the cache (rel, location, md5) has it, unless forced; remote: the store's keys name it, and the cache takes
    over its place; pending (manual mode, noted without an upload) or upload.
    """
    kind = F.lower(F.regexp_extract("rel", r"[^/.](\.[^./]+)$", 1))
    texts = files.where(kind.isin(*REMOTE_TYPES))
    had = cache.select("rel", F.col("location").alias("had"), F.col("md5").alias("had_md5"))
    had = had.limit(0) if force else had
    there = in_store(texts, keys).withColumn("there", F.lit(True))
    rows = texts.join(had, "rel", "left").join(there, "rel", "left")
    current = F.coalesce((F.col("had") != "") & (F.col("had_md5") == F.col("md5")), F.lit(False))
    action = F.when(current, "cached").when(F.col("there"), "remote").otherwise("pending" if manual else "upload")
    own = F.nullif(F.col("had"), F.lit(""))
    place = F.when(current, own).when(F.col("there"), F.coalesce(own, F.lit("manual-ui" if manual else "remote-existing"))).otherwise(F.lit("manual-ui") if manual else F.lit(None))
    return rows.select("rel", "md5", action.alias("action"), place.alias("location"))


def batch(state: DataFrame, files: DataFrame, n: int, order: list[str], interrupted: Column, key: str = "key") -> DataFrame:
    """The first n of the queue, completed if their file is there and failed with a reason if not, and the rest unchanged."""
    chosen = queue(state, interrupted, order).limit(n).select(key).withColumn("_now", F.lit(True))
    there = files.select(key).distinct().withColumn("_there", F.lit(True))
    rows = state.join(F.broadcast(chosen) if n <= 10_000 else chosen, key, "left").join(there, key, "left")
    status = F.when(F.col("_now") & F.col("_there"), "completed").when(F.col("_now"), "failed").otherwise(F.col("status"))
    return rows.select(*state.columns[: state.columns.index("status")], status.alias("status"), F.when(F.col("_now") & F.col("_there").isNull(), "file not found").alias("error"))


def unique_slugs(projects: DataFrame, order: list[str], slug: str = "slug") -> DataFrame:
    """Projects with a suffix -2, -3, ... for each further one of a slug, in their order."""
    place = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return projects.withColumn("_n", place).withColumn(slug, F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def history(sessions: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """file, rank, session and orphan: the newest sessions (session, date, files) of each file, whether `files` know it or not."""
    touched = sessions.select("session", "date", F.explode(F.array_distinct("files")).alias("file"))
    newest = Window.partitionBy("file").orderBy(F.desc("date"), F.desc("session"))
    top = touched.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most)
    return top.join(files.select("file").distinct().withColumn("_known", F.lit(True)), "file", "left").select("file", "rank", "session", F.col("_known").isNull().alias("orphan"))
