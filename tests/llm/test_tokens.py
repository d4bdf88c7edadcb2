"""Token counts and byte-level BPE against the libraries they must agree with."""

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from propensia.llm import byte_bpe, token_counts

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = ["'s", "'re", "'l", "'ll", "'x", "''", "a", "the", "ing", "é", "é", "Σ", "İ", "ß", "9", "12", "!", "?!", " ",
          "\n", " ", "\x1c", "<|endoftext|>", "<|startoftext", "|>", "日本", "ﬁ", "🎉", "<", "​", "\x85", "Hello",
          "      ", "\n\n  ", "aaaaaaaaaaaaaaaaaaaaaaa", "ababababab", "internationalization", "word "]


def texts(n: int, longest: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_counts_equal_the_library():
    t, lib = token_counts.transducer(WORDS), Tokenizer.from_file(WORDS)
    for s in texts(800, 14, 1):
        assert t.count_raw(s) == len(lib.encode(s, add_special_tokens=False).ids), repr(s)


def test_state_maps_compose_over_any_chunking_and_grouping():
    t, lib = token_counts.transducer(WORDS), Tokenizer.from_file(WORDS)
    whole = "".join(texts(60, 30, 2))
    expected = len(lib.encode(whole, add_special_tokens=False).ids)
    for size in (3, 17, 90):
        chunks = regex.findall(rf"(?s).{{1,{size}}}(?:[|>a-z]|[^\x00-\x7f])*+", whole)
        assert "".join(chunks) == whole and len(chunks) > 5
        maps = [t.state_map(c) for c in chunks]
        left = maps[0]
        for m in maps[1:]:
            left = t.compose(left, m)
        while len(maps) > 1:
            maps = [t.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        assert t.finish(left) == t.finish(maps[0]) == expected


def test_states_forgotten_midway_change_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 20)
    t, lib = token_counts.Transducer(WORDS), Tokenizer.from_file(WORDS)
    for s in texts(100, 20, 3):
        assert t.count_raw(s) == len(lib.encode(s, add_special_tokens=False).ids)


def test_long_documents_meet_over_the_scan(spark):
    lib = Tokenizer.from_file(WORDS)
    long = "".join(texts(4000, 30, 4))
    no_space = "aé9-" * 60_000
    assert len(long) > 3 * token_counts.CHUNK_CHARS
    rows = [(1, long), (2, None), (3, "x"), (3, "x"), (4, ""), (None, "two words"), (5, no_space)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    want = sorted((i is None, i or 0, len((s or "").encode()), len(lib.encode(s or "", add_special_tokens=False).ids)) for i, s in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want


def encoding():
    import base64

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_reduction_equals_the_library(monkeypatch):
    c, lib = byte_bpe.Codec(RANKS, P.PATTERN), encoding()
    for leaf_chars, leaf_bytes in ((7, 6), (40, 9), (1 << 15, 1 << 10)):
        monkeypatch.setattr(byte_bpe, "LEAF_CHARS", leaf_chars)
        monkeypatch.setattr(byte_bpe, "LEAF_BYTES", leaf_bytes)
        monkeypatch.setattr(byte_bpe, "LEAF_IDS", leaf_chars)
        for s in texts(400, 40, leaf_chars):
            c._known.clear()
            c._chunks.clear()
            ids = c.encode(s).tolist()
            assert ids == lib.encode_ordinary(s), repr(s)
            assert c.decode(ids) == s.encode()


def test_long_pieces_join_from_their_halves(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", 16)
    c, lib, rnd = byte_bpe.Codec(RANKS, P.PATTERN), encoding(), random.Random(5)
    for alphabet in ("ab", "abcdeinst", "=", " \n", "éa"):
        s = "".join(rnd.choice(alphabet) for _ in range(5000))
        c._known.clear()
        assert c.encode(s).tolist() == lib.encode_ordinary(s)


def test_encode_and_decode_of_a_table(spark):
    lib = encoding()
    rows = [(i, s) for i, s in enumerate(texts(60, 40, 6))] + [(100, None), (101, ""), (101, ""), (None, "x y"), (7, "z " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("a.b", F.lit(2))
    out = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, s in rows:
        ids = lib.encode_ordinary(s or "")
        want.append((str(i), len(ids), sha(" ".join(map(str, ids)).encode()), sha((s or "").encode())))
    assert sorted((str(r[0]), *r[1:]) for r in out) == sorted(want)


def test_ordinary_documents_are_joined_from_their_halves(spark):
    lib, c = encoding(), byte_bpe.Codec(RANKS, P.PATTERN)
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    joined = 0
    for s in docs:
        before = c.n_joins
        assert c.encode(s).tolist() == lib.encode_ordinary(s)
        joined += c.n_joins > before
    assert joined >= 0.9 * sum(len(s.split()) > 50 for s in docs) > 100


def test_empty_table_of_bpe(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(none, RANKS, P.PATTERN), RANKS, P.PATTERN)).count() == 0


def test_a_decoding_worker_builds_no_merge_table():
    c = byte_bpe.Codec(RANKS, P.PATTERN)
    assert c.decode(list(range(300))) == b"".join(c.bytes_of[i] for i in range(300))
    assert "_merge" not in c.__dict__
    assert c.decode(c.encode("two  words")) == b"two  words" and "_merge" in c.__dict__


def test_slices_give_memory_back_behind_the_last_batch(monkeypatch):
    from propensia.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    parts = common.slices(iter([pa.RecordBatch.from_arrays([pa.array(range(5))], names=["a"])]), 2)
    assert [next(parts).num_rows for _ in range(3)] == [2, 2, 1] and not calls
    assert list(parts) == [] and calls == [1]
    monkeypatch.undo()
    common.give_back()
