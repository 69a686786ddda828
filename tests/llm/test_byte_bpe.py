import hashlib
import struct

import public_tokenizers
import tiktoken

from scriptorium.llm import byte_bpe
from scriptorium.llm.queries import vocabulary
from tests.llm.cases import documents


def test_ids_are_those_of_the_vocabulary_and_texts_come_back(spark):
    ranks = vocabulary()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark)
    texts = [r["text"] or "" for r in docs.select("doc_id", "text").collect()]
    expected = sorted((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts for ids in [own.encode_ordinary(t)])
    found = byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == expected


def test_other_columns_stay_and_a_clashing_one_is_replaced(spark):
    docs = spark.createDataFrame([(1, "the end", "mine"), (2, None, None)], "doc_id long, text string, ids string")
    found = {r["doc_id"]: r for r in byte_bpe.encode(docs, vocabulary(), public_tokenizers.PATTERN).collect()}
    assert found[1]["text"] == "the end" and len(found[1]["ids"]) % 4 == 0 and found[2]["ids"] == b""
    assert byte_bpe.encode(docs.limit(0), vocabulary(), public_tokenizers.PATTERN).count() == 0


def test_a_worker_may_forget_and_long_texts_go_in_steps(monkeypatch):
    codec = byte_bpe.Codec(byte_bpe.model_of(vocabulary()), public_tokenizers.PATTERN)
    text = " ".join(f"w{i}x{i * 7}" for i in range(5000))
    whole = codec.encode(text)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    monkeypatch.setattr(byte_bpe, "STEP", 100)
    other = byte_bpe.Codec(byte_bpe.model_of(vocabulary()), public_tokenizers.PATTERN)
    assert other.encode(text) == whole and other.decode(whole) == text.encode()


def test_one_pass_gives_what_two_passes_give(spark):
    docs, ranks = documents(spark), vocabulary()
    one = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    two = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert byte_bpe.round_trip(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
