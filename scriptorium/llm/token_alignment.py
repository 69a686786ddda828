"""Alignment of two tokenizers: where do their tokens end together, and which tokens are counterparts how often.

A is a byte-level BPE (its JSON file), B a sentencepiece BPE with byte fallback; both encode the text with a space before
it, and both give bytes back. Where tokens of A and of B end at one byte, they are linked: a pair of ids, packed into an
int64 key.

1. Texts are aligned in slabs: ids, sizes and digests of documents, the slab's distinct keys and, for each link, which key.
2. Each partition counts its keys by np.unique; the counts are sorted globally by ranges of keys, and runs of one key are
   summed. So the count table is a row of sorted shards.
3. A slab asks each shard for its distinct keys; the shard finds them by searchsorted; the slab sums its documents' answers.

Shards are searched where Arrow has put them in a worker's memory. A file that all executors map doesn't exist on a
cluster whose shared folder only Spark reads, so shards travel to the slabs' questions in a join, each with a bounded number of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.llm.byte_bpe import byte_alphabet
from scriptorium.llm.common import bounded_batches, cut, q, small, unpacked
from scriptorium.llm.lm_scoring import expanded, squeezed

#: Links and documents of a slab; a longer document is a slab of its own.
SLAB, SLAB_DOCS = 1 << 20, 16_384
#: Keys of a shard of the count table, and questions of slabs that one copy of a shard answers.
SHARD, QUESTIONS = 1 << 17, 64
#: Distinct keys in hand of a task that counts.
HELD = 1 << 21
#: Code points encoded at once, where a text has a place at which both tokenizers must cut.
STEP = 200_000
#: A single space between small letters: a pre-token of A starts there, and a piece of B.
_BOTH_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")
#: B writes a space so.
SPACE = "▁"
_B = 32


class Aligner:
    """Both tokenizers of a worker. a_json and b_model are the contents of their files, `pattern` is A's for pre-tokens."""

    def __init__(self, a_json: str, b_model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        self.a_json, self.exact = a_json, None
        read = json.loads(a_json)
        added, back = {t["content"]: t["id"] for t in read["added_tokens"]}, {letter: b for b, letter in enumerate(byte_alphabet())}
        ranks = {bytes(back[x] for x in token): i for token, i in read["model"]["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        a_bytes = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            a_bytes[i] = token
        size = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(size)))
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_unknown(i) or self.b.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.steps = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.bytes = a_bytes, b_bytes
        self.sizes = tuple(np.array([len(x) for x in own], np.int64) for own in self.bytes)
        #: How an id is written: A's ids and then B's, each inside of its side of a group and at the side's end.
        self.written = [x for own, ends in zip(self.bytes, (b",|", b",;")) for i in range(len(own)) for x in (b"%d%c" % (i, ends[0]), b"%d%c" % (i, ends[1]))]

    def _a(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # a pattern's engine gives up on very long runs of white space by a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_str(self.a_json)
            self.exact.encode_special_tokens = True
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int64)

    def _b(self, text: str) -> list[int]:
        """`text` begins with the space that B adds."""
        return self.b.encode(text[1:]) if len(text) > 1 else [self.b.piece_to_id(SPACE)]

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while self.steps and len(text) - at > 2 * STEP and (found := _BOTH_CUT.search(text, at + STEP)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def align(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, B's ids, for each place where both end the number of the token in A, and in B); all empty if the text
        is, or if either doesn't give its bytes back."""
        none = (np.empty(0, np.int64),) * 4
        if not text:
            return none
        whole = " " + text
        ids: tuple[list, list] = [], []
        for part in self._parts(whole):
            ids[0].append(self._a(part)), ids[1].append(np.array(self._b(part), np.int64))
        a, b = (np.concatenate(x).astype(np.int64) for x in ids)
        data = whole.encode("utf-8", "surrogatepass")
        ends = [np.cumsum(size[own]) for size, own in zip(self.sizes, (a, b))]
        for own, end, tokens in zip((a, b), ends, self.bytes):
            if not len(own) or end[-1] != len(data) or b"".join(map(tokens.__getitem__, own.tolist())) != data:
                return none
        at = np.searchsorted(ends[1], ends[0])
        hit = np.flatnonzero(ends[1][at] == ends[0])
        return a, b, hit, at[hit]

    def spelled(self, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> bytes:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        in_a, in_b = np.diff(a_at, prepend=-1), np.diff(b_at, prepend=-1)
        codes = np.empty(len(a) + len(b), np.int64)
        own_a, own_b = 2 * a, 2 * (b + len(self.bytes[0]))
        own_a[a_at] += 1
        own_b[b_at] += 1
        codes[np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = own_a
        codes[np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)] = own_b
        return b"".join(map(self.written.__getitem__, codes.tolist()))[:-1]


_aligners: dict[int, Aligner] = {}


def _aligner(files) -> Aligner:
    """One for each worker and pair of files, kept from task to task."""
    key = hash(files.value)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*files.value)
    return _aligners[key]


def _files(docs: DataFrame, a_json: str, b_model: bytes, pattern: str):
    """A broadcast of the size of both vocabularies, whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast((a_json, b_model, pattern))


def align(docs: DataFrame, a_json: str, b_model: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Every row of `docs` with a_ids and b_ids (ids of both tokenizers) and a_ends and b_ends (for each group of tokens
    that end together, how many of either side's tokens have ended).

    All four are empty for null and empty texts, and for those that either tokenizer doesn't give back byte by byte.
    Repeated rows stay repeated, columns of those names are replaced, an empty table gives an empty table."""
    made = ["a_ids", "b_ids", "a_ends", "b_ends"]
    names = [c for c in docs.columns if c not in made]
    files = _files(docs, a_json, b_model, pattern)
    rows = docs.select(F.struct(F.lit(0), *[q(c) for c in names]).alias("_row"), q(text).cast("string").alias("_text"))
    schema = T.StructType([rows.schema["_row"], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(files)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [(a, b, x + 1, y + 1) for a, b, x, y in map(own.align, part.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *[pa.array([x.astype(np.int32) for x in side], pa.list_(pa.int32())) for side in zip(*found)]], names=["_row", *made])

    return bounded_batches(rows).mapInArrow(run, schema).select(*unpacked(docs, names, "_row"), *made)


def _slabs(batches: Iterator[pa.RecordBatch], own: Aligner, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row for each slab of documents; distinct keys are sorted."""
    part, number, ids, numbers, digests, keys, n = TaskContext.get().partitionId(), 0, [], [], [], [], 0

    def done() -> pa.RecordBatch:
        distinct, at, often = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        n_a, n_b, sizes = zip(*numbers)
        values = [(part << 32) | number, ids, n_a, n_b, sizes, digests, len(distinct), squeezed(np.diff(distinct, prepend=0)), squeezed(often), squeezed(at)]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), pa.list_(id_type), longs, longs, longs, pa.list_(pa.string()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["slab", "ids", "n_a", "n_b", "n_groups", "digests", "n_keys", "keys", "often", "links"])

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                a, b, a_at, b_at = own.align(text)
                if ids and (n + len(a_at) > SLAB or len(ids) == SLAB_DOCS):
                    yield done()
                    number, ids, numbers, digests, keys, n = number + 1, [], [], [], [], 0
                ids.append(doc), numbers.append((len(a), len(b), len(a_at))), keys.append((b[b_at] << _B) | a[a_at])
                digests.append(sha256(own.spelled(a, b, a_at, b_at)).hexdigest() if len(a) else "")
                n += len(a_at)
    if ids:
        yield done()


def _distinct(keys: bytes, n: int) -> np.ndarray:
    return np.cumsum(expanded(keys, n).astype(np.int64))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return distinct, total


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of one partition's slabs; a task with very many distinct keys tells some of them twice."""
    keys, counts = [], []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], names=["key", "n"])

    for batch in batches:
        for row in batch.to_pylist():
            keys.append(_distinct(row["keys"], row["n_keys"])), counts.append(expanded(row["often"], row["n_keys"]).astype(np.int64))
            if sum(map(len, keys)) > HELD:
                (distinct, total), keys, counts = _summed(keys, counts), [], []
                keys, counts = [distinct], [total]
                if len(distinct) > HELD // 2:
                    yield told()
                    keys, counts = [], []
    if keys:
        distinct, total = _summed(keys, counts)
        keys, counts = [distinct], [total]
        yield told()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the runs of equal keys in a sorted partition; a run may go on in the next batch."""
    last, rest = None, 0
    for batch in batches:
        keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sums, keys = np.add.reduceat(n, starts), keys[starts]
        if last == keys[0]:
            sums[0] += rest
        elif last is not None:
            yield pa.RecordBatch.from_pydict({"key": [last], "n": [rest]})
        last, rest = int(keys[-1]), int(sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], names=["key", "n"])
    if last is not None:
        yield pa.RecordBatch.from_pydict({"key": [last], "n": [rest]})


def _counted(slabs: DataFrame) -> DataFrame:
    """(key, n) of the corpus, sorted inside of partitions that hold ranges of keys."""
    partial = cut(slabs.select("keys", "often", "n_keys").mapInArrow(_partial, "key long, n long"))
    return cut(partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_runs, "key long, n long"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counts, packed: the first key names the shard. A value is twice the count, and one more where it is
    the highest of its id of B."""
    held: list[list[np.ndarray]] = [[], []]

    def pack(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(keys[0])]), pa.array([keys.tobytes()]), pa.array([values.tobytes()])], names=["shard", "keys", "values"])

    for batch in batches:
        held[0].append(batch.column(0).to_numpy()), held[1].append(batch.column(1).to_numpy())
        if sum(map(len, held[0])) >= SHARD:
            keys, values = map(np.concatenate, held)
            for at in range(0, len(keys) - SHARD + 1, SHARD):
                yield pack(keys[at : at + SHARD], values[at : at + SHARD])
            rest = len(keys) - len(keys) % SHARD
            held = [[keys[rest:]], [values[rest:]]]
    keys, values = (np.concatenate(x) if x else np.empty(0, np.int64) for x in held)
    if len(keys):
        yield pack(keys, values)


def _asked(batches: Iterator[pa.RecordBatch], firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each slab and shard: the slab's distinct keys there."""
    for batch in batches:
        for row in filter(lambda r: r["n_keys"], batch.to_pylist()):
            keys = _distinct(row["keys"], row["n_keys"])
            at = np.searchsorted(firsts, keys, side="right") - 1
            used, starts = np.unique(at, return_index=True)
            parts = np.split(keys, starts[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["slab"]] * len(used), pa.int64()), pa.array(firsts[used], pa.int64()), pa.array([len(p) for p in parts], pa.int32()), pa.array([squeezed(np.diff(p, prepend=0)) for p in parts], pa.binary())], names=["slab", "shard", "n_keys", "keys"]
            )


def _answered(shard: pa.Table, asked: pa.Table) -> pa.Table:
    """What one shard says to the slabs that ask it: the values of their keys, found in its sorted keys."""
    rows, out = asked.select(["slab", "shard", "n_keys", "keys"]).to_pylist(), []
    if rows:
        known, values = (np.frombuffer(shard.column(c).chunk(0)[0].as_buffer(), np.int64) for c in ("keys", "values"))
        out = [squeezed(values[np.searchsorted(known, _distinct(r["keys"], r["n_keys"]))]) for r in rows]
    longs = [pa.array([r[c] for r in rows], t) for c, t in (("slab", pa.int64()), ("shard", pa.int64()), ("n_keys", pa.int32()))]
    return pa.table([*longs, pa.array(out, pa.binary())], names=["slab", "shard", "n_keys", "values"])


def _gathered(slab: pa.Table, answers: pa.Table, id_type: pa.DataType) -> pa.Table:
    """The documents of one slab with their sums over the answers to its keys."""
    row, told = slab.to_pylist()[0], answers.sort_by("shard").to_pylist()
    value = np.concatenate([np.empty(0, np.int64), *[expanded(x["values"], x["n_keys"]).astype(np.int64) for x in told]])
    sizes = np.array(row["n_groups"], np.int64)
    mine = value[expanded(row["links"], int(sizes.sum())).astype(np.int64)]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (mine & 1, mine >> 1)]
    ends = np.cumsum(sizes)
    best, total = (x[ends] - x[ends - sizes] for x in sums)
    columns = [pa.array(row["ids"], id_type), *[pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_groups")], pa.array(best), pa.array(total), pa.array(row["digests"], pa.string())]
    return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _slab_table(docs: DataFrame, a_json: str, b_model: bytes, pattern: str, text: str, doc_id: str) -> DataFrame:
    files = _files(docs, a_json, b_model, pattern)
    rows = bounded_batches(docs).select(q(doc_id).alias("doc_id"), q(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    schema = f"slab long, ids array<{kind.simpleString()}>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, n_keys int, keys binary, often binary, links binary"
    return cut(rows.mapInArrow(lambda b: _slabs(b, _aligner(files), arrow_kind), schema))


def pair_counts(docs: DataFrame, a_json: str, b_model: bytes, pattern: str, text: str = "text") -> DataFrame:
    """a_id, b_id, n: how many links of the corpus hold the pair; no rows where no text has tokens."""
    slabs = _slab_table(docs.select(q(text).alias("text"), F.lit(0).alias("id")), a_json, b_model, pattern, "text", "id")
    key = F.col("key")
    return _counted(slabs).select(key.bitwiseAND((1 << _B) - 1).cast("int").alias("a_id"), F.shiftright(key, _B).cast("int").alias("b_id"), "n")


def measure(docs: DataFrame, a_json: str, b_model: bytes, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of `docs`.

    A text that is null or empty, or that either tokenizer doesn't give back, has zeros and an empty digest. Repeated
    rows are documents of their own, and their links count as often; rows without an id stay so. Other columns are not looked at; an
    empty table gives an empty table. Counts are those of all rows. A slab's questions to a shard are one row, so rows
    between stages grow with slabs times shards, and shards with the distinct pairs, at most the product of the vocabularies.
    """
    slabs = _slab_table(docs, a_json, b_model, pattern, text, doc_id)
    kind = docs.schema[doc_id].dataType
    arrow_kind = to_arrow_type(kind)
    counts = _counted(slabs)
    b_id = F.shiftright(F.col("key"), _B).alias("b_id")
    highest = small(counts.groupBy(b_id).agg(F.max("n").alias("most")), 1_000_000)  # a row for each id of B
    valued = counts.select("key", "n", b_id).join(highest, "b_id").select("key", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    shards = cut(valued.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_shards, "shard long, keys binary, values binary"))
    firsts = np.array(sorted(r["shard"] for r in shards.select("shard").collect()), np.int64)  # one for each SHARD pairs
    copies = max(1, -(-slabs.count() // QUESTIONS))
    asked = slabs.select("slab", "keys", "n_keys").mapInArrow(lambda b: _asked(b, firsts), "slab long, shard long, n_keys int, keys binary")
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("slab"), F.lit(copies)).cast("int"))
    copied = shards.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    answers = copied.groupBy("shard", "copy").cogroup(asked.groupBy("shard", "copy")).applyInArrow(lambda a, b: _answered(a, b), "slab long, shard long, n_keys int, values binary")
    own = slabs.select("slab", "ids", "n_a", "n_b", "n_groups", "digests", "links")
    schema = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(lambda a, b: _gathered(a, b, arrow_kind), schema)
