import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cumulus.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder.from_file(RANKS)


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_every_code_point_in_context(own, other):
    texts = [f"a{chr(c)}1{chr(c)}! {chr(c)}  {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += [f"a{chr(c)}1{chr(c)}! {chr(c)}  {chr(c)}" for c in range(0x3000, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    assert [ids(x) for x in own.encode_texts([t.encode() for t in texts])] == other.encode_ordinary_batch(texts)


def test_random_texts(own, other):
    draw = random.Random(5)
    alphabet = "aB z'sstmdrevl 1 29é!?\n\t    　x'’.-日\U0001f600"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 80))) for _ in range(5000)]
    assert [ids(x) for x in own.encode_texts([t.encode() for t in texts])] == other.encode_ordinary_batch(texts)


def test_long_texts_and_long_slices(own, other):
    texts = ["ab" * 3000 + " " + "x" * 5000, " " * 100_000, "a b " * 600_000 + "'s " * 10, "", "日本" * 50_000]
    assert [ids(x) for x in own.encode_texts([t.encode() for t in texts])] == [other.encode_ordinary(t) for t in texts]


def test_small_cache_changes_nothing(own, other, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 10)
    fresh = bpe.Encoder(own.ranks)
    texts = [f"word{i} other{i * 7} word{i}" for i in range(200)]
    for t in texts:
        assert ids(fresh.encode_texts([t.encode()])[0]) == other.encode_ordinary(t)


def test_scan_is_associative():
    table = bpe._COMPOSE.reshape(bpe._SIZE, bpe._SIZE)
    every = range(bpe._SIZE)
    assert all(table[table[a, b], c] == table[a, table[b, c]] for a in every for b in every for c in every)


def test_special_strings_only_where_asked(own):
    text = b"a<|endoftext|>b<|endoftext|>"
    assert 50256 not in ids(own.encode_texts([text])[0])
    special = bpe.Encoder(own.ranks, {"<|endoftext|>": 50256})
    got = ids(special.encode_texts([text])[0])
    assert got.count(50256) == 2 and got[-1] == 50256
    assert bpe.decode_ids(special.encode_texts([text])[0], special.tables()[0]) == text


def test_frame_with_nulls_repeats_and_clashing_names(spark, other):
    rows = [(1, "Hello  world's\n", "x"), (2, None, "y"), (3, "", None), (1, "Hello  world's\n", "x"), (None, "é日", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = bpe.encode(docs, RANKS, offsets="starts", decoded="decoded").collect()
    assert len(out) == 5 and set(out[0].asDict()) == {"doc_id", "text", "token_ids", "starts", "decoded"}
    for r in out:
        text = r.text or ""
        assert ids(r.token_ids) == other.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        starts = np.frombuffer(r.starts, dtype="<u8").tolist()
        assert len(starts) == len(ids(r.token_ids)) and starts[:1] == [0] * bool(text)
    again = bpe.decode(bpe.encode(docs, RANKS), RANKS, out="text").collect()
    assert sorted(bytes(r.text) for r in again) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(docs.limit(0), RANKS, decoded="d").count() == 0


def test_query_digests(spark, other):
    from cumulus.llm.queries import op1_byte_bpe
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op1_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = np.array(other.encode_ordinary(d.text or ""), dtype="<u4").tobytes()
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_slices_are_named_once_and_zero_bytes_are_kept():
    for buffer in (b"aa bb aa twelve byteslong twelve byteslong \xc3\xa9\xc3\xa9", b"a\0 a a\0\0 a", b"x"):
        begin = np.array([0, *(i for i in range(1, len(buffer)) if buffer[i:i + 1] == b" ")])
        end = np.append(begin[1:], len(buffer))
        slices, which = bpe._distinct_slices(buffer, begin, end)
        assert [slices[k] for k in which] == [buffer[a:b] for a, b in zip(begin, end)]
        short = [s for s in slices if len(s) <= 8]
        assert b"\0" in buffer or len(set(short)) == len(short)


def test_pairs_of_the_table_and_merges_against_the_heap():
    draw = random.Random(5)
    own = bpe.Encoder.from_file(RANKS)
    keys = np.array(list(own.pairs), dtype=np.int64)
    assert (own._rank(keys >> 20, keys & 0xFFFFF) == np.array(list(own.pairs.values()))).all()
    none = np.array([-1, 3, -1, 50_256])
    assert (own._rank(none, np.array([3, -1, -1, 50_256])) == bpe.NO_RANK).all()
    slices = [bytes(draw.choice(b" etaoinshrdlu\xc3\xa9\0" if draw.random() < 0.9 else range(256)) for _ in range(draw.randint(1, 32)))
              for _ in range(3000)]
    assert own.merge_together(slices) == [own.merge_long(s) for s in slices]
