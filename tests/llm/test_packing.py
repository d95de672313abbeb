"""op2: whole documents come back, windows are full, lengths are rational."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = packing.WordTokens(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, pieces, tokenizer, window):
    """Every id of every row in exactly one piece; sequences gapless, at most window, and padded nowhere."""
    want = {}
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault((doc, len(ids)), []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for key, found in by_doc.items():
        if len(want[key]) > 1:
            assert sum(p.length for p in found) == key[1] * len(want[key])
            continue
        at, ids = 0, want[key][0]
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padded = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    assert padded == 0


@pytest.mark.parametrize("seed,n,most", [(1, 60, 40), (2, 300, 700), (3, 12, 6000), (4, 1, 1)])
def test_pieces_of_random_documents(spark, tokenizer, seed, n, most):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "x.", "naïve", "!?", "1234", "don't", "über-alles", "<|endoftext|>", "é", "日本語", "\U0001f600"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, most)))) for i in range(n)] + [(10_000, None), (10_001, ""), (10_002, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(rows, packing.pack(df, PATH).collect(), tokenizer, 2048)


def test_null_repeated_and_large_ids_and_empty_table(spark, tokenizer):
    rows = [(5, "a b"), (5, "a b"), (None, "a b c"), (2**60 + 1, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, packing.pack(df, PATH).collect(), tokenizer, 2048)
    assert packing.pack(df.limit(0), PATH).count() == 0


@given(st.lists(st.text(max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_alone_give_the_ids_of_whole_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert WORDS.encode(texts) == [np.array(e.ids, np.uint16).tobytes() for e in WORDS.tokenizer.encode_batch(texts, add_special_tokens=False)]


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_a_plan_places_every_rank_once(counts):
    window = 64
    plan = packing.Plan.of(counts, window)
    cuts, taken = plan.cuts, {}
    for n, c in counts.items():
        for rank in range(c):
            found = plan.pieces(n, rank, cuts)
            assert sum(p[1] for p in found) == n
            for _, length, sequence, offset in found:
                taken.setdefault(sequence, []).append((offset, length))
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_least_squares_meets_a_histogram_of_known_repeats():
    found = [{10: 1, 54: 1}, {20: 2, 24: 1}, {10: 1, 20: 1, 34: 1}]
    x = np.array([7, 4, 3])
    counts = {10: 10, 54: 7, 20: 11, 24: 4, 34: 3}
    assert np.allclose(packing.repeat_counts(found, counts), x, atol=0.2)
    assert all(sum(n * m for n, m in c.items()) == 64 for c in packing.combinations(counts, 64))


def test_workers_do_not_read_the_vocabulary_as_objects(monkeypatch):
    ranks = packing.byte_ranks(PATH)
    monkeypatch.setattr(packing, "_merges", lambda path: pytest.fail("read again"))
    texts = ["Alpha, beta 12", "naïve 日本語"]
    assert packing.WordTokens(PATH, ranks).encode(texts) == WORDS.encode(texts)
