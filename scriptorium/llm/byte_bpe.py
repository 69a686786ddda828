"""Byte-level BPE encoding and decoding with a sentencepiece model made directly from a rank vocabulary.

Every byte is mapped to one printable code point, every vocabulary entry becomes a piece of such code points with the
score -rank, and normalisation is the identity; so the merge with the highest score is the merge with the lowest rank,
leftmost first, as byte-level BPE asks. Texts are cut into pre-tokens by the vocabulary's pattern. The model travels as
a broadcast: its size is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import bounded_batches, q

#: A worker forgets what it remembers of pre-tokens beyond this many; a pure cache, without influence on results.
REMEMBERED = 150_000
#: Longer pre-tokens are encoded anew each time.
LONGEST_REMEMBERED = 48
#: Pre-tokens in hand at once, so that memory does not grow with the length of a text.
STEP = 200_000
#: Begins the pieces that stand for no bytes; no byte is mapped to it.
OUTSIDE = "\u2047"


def byte_alphabet() -> list[str]:
    """A printable code point for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank, from a path of the driver."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: piece i is the token of rank i; one unknown piece follows the last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters, by_rank = byte_alphabet(), {rank: token for token, rank in ranks.items()}
    model = pb.ModelProto()
    for i in range(max(by_rank, default=-1) + 1):
        piece = model.pieces.add()
        token = by_rank.get(i)
        piece.piece = "".join(letters[b] for b in token) if token is not None else f"{OUTSIDE}{i}"
        piece.score = float(-i)
        piece.type = pb.ModelProto.SentencePiece.NORMAL if token is not None else pb.ModelProto.SentencePiece.UNUSED
    unknown = model.pieces.add()
    unknown.piece, unknown.type = f"{OUTSIDE}unknown", pb.ModelProto.SentencePiece.UNKNOWN
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(model.pieces) - 1
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one model; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pattern = regex.compile(pattern)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_alphabet()
        back = {letter: b for b, letter in enumerate(letters)}
        self.letters = {b: letter for b, letter in enumerate(letters)}
        size = self.processor.get_piece_size() - 1
        pieces = self.processor.id_to_piece(list(range(size)))
        self.tokens = [b"" if p.startswith(OUTSIDE) else bytes(back[x] for x in p) for p in pieces]
        self.whole: dict[str, bytes] = {}
        for i, token in enumerate(self.tokens):  # a pre-token that is itself a token is that token
            try:
                if token:
                    self.whole[token.decode("utf-8")] = array("I", [i]).tobytes()
            except UnicodeDecodeError:
                pass
        self.known = dict(self.whole)

    def encode(self, text: str) -> bytes:
        out, pieces = [], (m.group() for m in self.pattern.finditer(text)) if len(text) > 4 * STEP else iter(self.pattern.findall(text))
        while part := list(islice(pieces, STEP)):
            out.append(self._encode(part))
        return b"".join(out)

    def _encode(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            pass
        new = [x for x in set(pieces) if x not in self.known]
        mapped = [x.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for x in new]
        found = {x: array("I", ids).tobytes() for x, ids in zip(new, self.processor.encode(mapped, out_type=int, num_threads=1))}
        here = {x: self.known[x] for x in set(pieces) if x in self.known} | found
        if len(self.known) + len(found) > REMEMBERED + len(self.whole):
            self.known = dict(self.whole)
        self.known.update((x, ids) for x, ids in found.items() if len(x) <= LONGEST_REMEMBERED)
        return b"".join(map(here.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(model, pattern: str) -> Codec:
    """One codec for each worker and model, kept from task to task."""
    key = (hash(model.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model.value, pattern)
    return _codecs[key]


def _mapped(df: DataFrame, source: str, targets: list[str], model, pattern: str, work) -> DataFrame:
    """`df` with binary columns made from `source` by work(codec, value), in place of any columns of those names."""
    names = [c for c in df.columns if c not in targets]
    schema = T.StructType([*[df.schema[c] for c in names], *[T.StructField(t, T.BinaryType(), False) for t in targets]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = zip(*[work(codec, x) for x in part.column(source).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *[pa.array(x, pa.binary()) for x in made]], names=[*names, *targets])

    return bounded_batches(df).mapInArrow(run, schema)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs if isinstance(docs.schema[text].dataType, T.StringType) else docs.withColumn(text, q(text).cast("string"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row of `docs` with the ids of its whole text as a binary column of little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows stay repeated; all other columns are kept, but one named as `ids` is
    replaced. Special tokens are never produced. Nothing is shuffled, and each text is worked on in steps.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_of(ranks))
    return _mapped(_texts(docs, text), text, [ids], model, pattern, lambda codec, x: (codec.encode(x or ""),))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """What decode(encode(docs)) gives, with both in one pass: a worker encodes a text and decodes its ids, so that a task
    needs one worker and one model, not two.

    Null and empty texts have no ids and decode to nothing, repeated rows stay repeated, columns of both names are replaced and
    all others kept, and an empty table gives an empty table."""
    model = docs.sparkSession.sparkContext.broadcast(model_of(ranks))

    def both(codec: Codec, x: str | None) -> tuple[bytes, bytes]:
        coded = codec.encode(x or "")
        return coded, codec.decode(coded)

    return _mapped(_texts(docs, text), text, [ids, decoded], model, pattern, both)


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the bytes that its ids stand for; null ids decode to nothing, an id outside the vocabulary fails."""
    model = encoded.sparkSession.sparkContext.broadcast(model_of(ranks))
    return _mapped(encoded, ids, [decoded], model, pattern, lambda codec, x: (codec.decode(x or b""),))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the bytes that they decode to.

    A null text is an empty one, repeated rows stay repeated, other columns are not looked at, an empty table gives an empty
    table."""
    coded = round_trip(docs.select("doc_id", "text"), ranks, pattern)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
