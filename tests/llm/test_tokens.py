"""Token ids, packing, the token store and the BPE codec against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracelens.llm import bpe, packing, token_store, tokens
from tracelens.session import work_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\n\n", "\n\n\n", " \n", "\n ", "\t", "\r\n", "\xa0", " ", "a", "B", "'s", "'", "'ll", "9", "²", "!!", "<|endoftext|>",
         "<|startoftext|>", "é", "é", "日本", "\0", "x\0y", "🙂", "_", "\x1c", "\x85", "Ünï", " ab", "\nf", "ΣΑΣ", "İ", "aaaaaaaa", "ababab", "hello"]
TEXTS = [None, "", " ", "a", "The quick brown fox.", "x" * 30_000, "word " * 9_000, "Ünïcödé ΣΑΣ", "one\ntwo\n\nthree", "<|endoftext|> in a text"]


def mixed(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def library_ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def frame(spark, texts, parts=3):
    rows = [(i * 10 if i % 4 else None, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, sequence_id int").repartition(parts)


def test_words_together_give_the_library_ids():
    library, own = Tokenizer.from_file(BYTE), tokens.WordEncoder(BYTE)
    texts = mixed(4_000, 1) + [" ".join(mixed(6, k)) for k in range(300)] + TEXTS[1:]
    assert own.encode_all(pa.array(texts)) == [library_ids(library, t) for t in texts]
    assert own.encode(None) == b""


def test_small_dictionaries_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    library, own = Tokenizer.from_file(BYTE), tokens.WordEncoder(BYTE)
    texts = [" ".join(mixed(6, k)) for k in range(60)]
    for t in texts:
        assert own.encode(t) == library_ids(library, t)


def test_pair_index_equals_the_library():
    library, own = Tokenizer.from_file(WORD), bpe.Codec(WORD)
    texts = mixed(4_000, 2) + ["ab" * 500, "a" * 999] + TEXTS[1:]
    for text, ids in zip(texts, own.encode_all(pa.array(texts)), strict=True):
        assert ids == library_ids(library, text), text
        plain = np.frombuffer(ids, "<u4").tolist()
        assert own.decode(plain) == library.decode(plain, skip_special_tokens=False)


def test_pair_index_applies_a_lower_rank_that_arises():
    # merging (b, c) makes a pair of lower rank with a; the second (b, c) of the word must wait
    merges = {(1 << 32 | 2): (5, 4), (0 << 32 | 4): (1, 5), (5 << 32 | 1): (2, 6)}
    index = bpe.PairIndex([[0, 1, 2, 1, 2], [], [1, 2]], merges)
    index.merge_all()
    assert list(index.words()) == [[6, 2], [], [4]]


def test_bpe_operator(spark):
    library = Tokenizer.from_file(WORD)
    out = bpe.encode_documents(frame(spark, TEXTS), WORD).collect()
    want = Counter((i * 10 if i % 4 else None, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want
    assert bpe.encode_documents(frame(spark, TEXTS).limit(0), WORD).count() == 0


def best_sum(lengths, capacity):
    """Largest sum up to capacity with the largest usable length, by plain subset sums."""
    usable = [n for n in lengths if n <= capacity]
    if not usable:
        return 0
    first = max(usable)
    usable.remove(first)
    sums = {first}
    for n in usable:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_fill_is_closest_to_capacity():
    r = random.Random(3)
    for _ in range(300):
        lengths = [r.randint(1, 40) for _ in range(r.randint(0, 12))]
        counts = Counter(lengths)
        chosen = packing.fill(counts, 64)
        assert sum(n * k for n, k in chosen) == best_sum(lengths, 64)
        assert all(0 < k <= counts[n] for n, k in chosen)


def test_blocks_leave_no_padding():
    r = random.Random(4)
    for _ in range(100):
        remainders = [(k, 5, r.randint(1, 63)) for k in range(r.randint(0, 40))]
        sequences = packing.pack_block(remainders, 64)
        assert all(sum(p[2] for p in s) == 64 for s in sequences[: sum(n for *_, n in remainders) // 64])
        assert all(bin(sum(p[2] for p in s)).count("1") == 1 for s in sequences)
        covered = sorted((doc, k) for s in sequences for doc, start, n in s for k in range(start, start + n))
        assert covered == sorted((doc, k) for doc, start, n in remainders for k in range(start, start + n))


def test_packing_covers_every_id_once(spark):
    texts = TEXTS + ["a few words more"] * 50
    library = Tokenizer.from_file(BYTE)
    rows = [(i, t) for i, t in enumerate(texts)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), BYTE, block_docs=7).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for i, t in rows:
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in own) == library_ids(library, t) + np.uint32(1).tobytes()
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        assert all(p["doc_tokens"] == sum(q["length"] for q in own) for p in own)
    for s in by_sequence.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == np.cumsum([0] + [p["length"] for p in s])[:-1].tolist()
        assert sum(p["length"] for p in s) <= 2048
    assert packing.pack_documents(frame(spark, []), BYTE).count() == 0
    assert {p["doc_id"] for p in packing.pack_documents(frame(spark, TEXTS), BYTE).collect()} >= {None, 10}
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(frame(spark, TEXTS), BYTE, window=100)


def test_store_round_trip(spark):
    library = Tokenizer.from_file(BYTE)
    texts = TEXTS + [f"short document number {k} about nothing much" for k in range(300)]
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, frame string")
    path = work_dir(spark, "store")
    token_store.write_store(docs, path, BYTE, end_id=2, shard_bytes=4_000)
    rows = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, t in zip(rows, texts, strict=True):
        want = library_ids(library, t) + np.uint32(2).tobytes()
        assert (bytes(r["ids"]), r["n_tokens"], r["start"]) == (want, len(want) // 4, start)
        start += r["n_tokens"]
    meta = spark.read.parquet(f"{path}/dictionary").first()
    assert len(meta["dictionary"]) > 0 and spark.read.parquet(f"{path}/shards").count() > 1
    some = {r["doc_id"]: bytes(r["ids"]) for r in token_store.read_documents(spark, path, [30, 300, 7]).collect()}
    assert some == {i: bytes(rows[i // 3]["ids"]) for i in (30, 300)}


def test_store_with_null_and_repeated_ids_and_without_rows(spark):
    path = work_dir(spark, "store")
    token_store.write_store(frame(spark, TEXTS * 2), path, BYTE, end_id=2)
    rows = token_store.read_store(spark, path).collect()
    assert len(rows) == 2 * len(TEXTS) and sum(r["doc_id"] is None for r in rows) == 5
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in order] == sorted(r["doc_id"] or -1 for r in rows)
    assert zlib.crc32(bytes(order[0]["ids"])) >= 0
    token_store.write_store(frame(spark, TEXTS).limit(0), path, BYTE, end_id=2)
    assert token_store.read_store(spark, path).count() == 0
