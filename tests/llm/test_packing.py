import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cumulus.llm import packing
from cumulus.llm.queries import RANKS, SPECIALS, op3_packing


def best_fit_decreasing(lengths, window):
    """Windows that the plain method uses, as their sorted fillings."""
    windows = []
    for n in sorted(lengths, reverse=True):
        fits = [w for w in windows if window - sum(w) >= n]
        if fits:
            min(fits, key=lambda w: window - sum(w)).append(n)
        else:
            windows.append([n])
    return sorted(map(sum, windows))


def test_plan_is_best_fit_decreasing():
    draw = random.Random(3)
    for window in (7, 16, 100):
        for _ in range(30):
            lengths = [draw.randint(1, window) for _ in range(draw.randint(0, 200))]
            plan = sorted(packing.plan_windows(dict(Counter(lengths)), window))
            filled, places = Counter(), {}
            for (n, rank, first, offset), after in zip(plan, [*plan[1:], None]):
                end = after[1] if after and after[0] == n else Counter(lengths)[n]
                for k in range(first, first + end - rank):
                    filled[k] += n
                    places.setdefault(k, []).append((offset, offset + n))
            for spans in places.values():
                spans.sort()
                assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert sorted(filled.values()) == best_fit_decreasing(lengths, window)


def test_tree_finds_the_tightest():
    tree = packing.CapacityTree(1024)
    assert tree.tightest(1) is None
    tree.add(5, 1)
    tree.add(1024, 2)
    assert [tree.tightest(n) for n in (1, 5, 6, 1024)] == [5, 5, 1024, 1024]
    tree.add(5, -1)
    assert tree.tightest(1) == 1024


def check_pieces(rows, texts, window=1024):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want[i]))
            cut = np.array(want[i][at:at + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(cut) and len(cut) == 4 * r.length
            at += r.length
        assert at == len(want[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padded = at if at & (at - 1) == 0 else window
        assert {r.padded_length for r in pieces} == {padded}
    return sum({r.sequence_id: r.padded_length for r in rows}.values())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_packing(spark, sf).collect()
    padded = check_pieces(rows, texts)
    assert padded < 1.03 * sum(r.length for r in rows) + 1024


def test_nulls_specials_long_texts_and_other_columns(spark):
    texts = {1: None, 2: "", 3: "a <|endoftext|> b", 4: "word " * 5000, 5: "same text", 6: "same text"}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()],
                                 "doc_id long, text string, length string, sequence_id int")
    check_pieces(packing.pack(docs, RANKS, specials=SPECIALS).collect(), texts)
    assert packing.pack(docs.limit(0), RANKS).count() == 0


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "d")], "doc_id long, text string")
    rows = packing.pack(docs, RANKS).collect()
    assert len(rows) == 6 and len({(r.sequence_id, r.offset) for r in rows}) == 6
