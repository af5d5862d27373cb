"""Packing: pieces against the tokenizers library, places against the contract, and the search against best fit."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from salesloom.llm import common, packing
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, slot long, length int, bin long, deal int, piece string, `a.b` int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def check_pieces(library, texts, got):
    """``texts``: (doc_id, text) rows; the pieces of equal rows are told apart only by their number."""
    want = defaultdict(int)
    for doc_id, text in texts:
        ids = ids_of(library, text)
        at = 0
        sizes = [len(ids)] if len(ids) <= 1024 else [len(ids) % 1024] * (len(ids) % 1024 > 0) + [1024] * (len(ids) // 1024)
        for k, size in enumerate(sizes):
            crc = zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())
            want[doc_id, k, at, size, crc] += 1
            at += size
    found = defaultdict(int)
    for r in got:
        found[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert found == want


def check_places(got):
    """Gapless from 0 in every sequence, and none over the limit."""
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_documents(spark, library):
    docs = common.table(spark, SF, "documents")
    got = packing.pack(docs, PATH).collect()
    check_pieces(library, [(r.doc_id, r.text) for r in docs.collect()], got)
    lengths = [r.length for r in got]
    used = check_places(got)
    assert used <= len(packing.best_fit(lengths))
    assert used <= 1.05 * sum(lengths) / 1024 + 1


def test_odd_rows_and_empty_table(spark, library):
    common.prepare(spark)
    texts = [
        (1, None), (1, ""), (None, "no id"), (2, "same"), (2, "same"), (2, "other"), (3, "<|endoftext|> inside <|endoftext|>"),
        (4, "word " * 5000), (5, " " * 70000 + "x"), (6, "x" * 3000), (7, "naïve 漢字     emoji 👍🏽 \r\n\t"), (8, "ab " * 1023),
    ]
    rows = spark.createDataFrame([(i, t, 1, 2, 3, 4, "p", 5) for i, t in texts], SCHEMA)
    got = packing.pack(rows, PATH).collect()
    check_pieces(library, texts, got)
    check_places(got)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_ids_of_every_kind_of_text(library):
    """tiktoken's ids are the library's for every character, beside letters, figures, blanks and signs."""
    encoder = packing.ByteEncoder(PATH)
    assert encoder.fast is not None
    rng = random.Random(4)
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(rng.randrange(0x3000, 0xD800)) for _ in range(2000)]
    texts = [f"a{c}b {c}1{c}2 {c} .{c}'s{c}{c} x" for c in every]
    for text, found in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert encoder.ids(text).tolist() == [*found.ids, 2]


def test_long_texts_in_stretches(library):
    rng = random.Random(5)
    text = "".join(rng.choice(["word", " ", "  ", "\n", " x1", "'s ", "é", "!", " 漢"]) for _ in range(90000))
    encoder = packing.ByteEncoder(PATH)
    parts = list(encoder.stretches(text))
    assert len(parts) > 2 and "".join(parts) == text
    assert encoder.ids(text).tolist() == ids_of(library, text)


def test_another_kind_of_vocabulary_goes_to_the_library(library):
    import json

    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    assert packing.ByteEncoder.ranked(spec) is None
    slow = packing.ByteEncoder(PATH)
    slow.fast = None
    assert slow.ids("some text").tolist() == ids_of(library, "some text")


def fills(bins, sizes):
    return [sum(sizes[i] for i in b) for b in bins]


def test_search_on_random_lengths():
    """No piece is lost, no bin overfull, never worse than best fit, and it empties bins where best fit wastes room."""
    rng = random.Random(6)
    better = 0
    for low, high in ((200, 500), (256, 520), (1, 1023), (100, 400), (340, 345), (600, 1000)):
        sizes = [rng.randint(low, high) for _ in range(1500)]
        start = packing.best_fit(sizes)
        assert sorted(i for b in start for i in b) == list(range(len(sizes))) and max(fills(start, sizes)) <= 1024
        for first in (start, [[i] for i in range(len(sizes))]):
            end = packing.improve(first, sizes)
            assert sorted(i for b in end for i in b) == list(range(len(sizes)))
            assert max(fills(end, sizes)) <= 1024
            assert sum(f * f for f in fills(end, sizes)) >= sum(f * f for f in fills(first, sizes))
        better += len(packing.improve(start, sizes)) < len(start)
        assert len(packing.improve(start, sizes)) <= len(start)
    assert better >= 3


def test_each_kind_of_exchange():
    def after(bins):
        sizes = [s for b in bins for s in b]
        numbers = iter(range(len(sizes)))
        return sorted(fills(packing.improve([[next(numbers) for _ in b] for b in bins], sizes), sizes))

    assert after([[600, 300], [124]]) == [1024]  # moved
    assert after([[600, 300], [424, 500]]) == [800, 1024]  # 424 for 300
    assert after([[800, 200], [100, 124]]) == [200, 1024]  # two for one
    assert after([[700, 100, 100], [324]]) == [200, 1024]  # one for two


def test_lengths_that_fit_exactly():
    """Sequences cut at random places: best fit needs more than there were, the search gets nearer."""
    rng = random.Random(7)
    sizes = []
    for _ in range(400):
        marks = sorted(rng.sample(range(1, 1024), 3))
        sizes += [b - a for a, b in zip([0, *marks], [*marks, 1024])]
    assert len(packing.improve(packing.best_fit(sizes), sizes)) <= 403


def test_rounds_bring_leftovers_together(spark):
    """With many small groups the bins left underfull in each meet in later rounds."""
    common.prepare(spark)
    rng = random.Random(8)
    sizes = [rng.randint(1, 700) for _ in range(4000)]
    short = spark.createDataFrame(list(enumerate(sizes)), "slot long, length int")
    got = packing.search(short, group=200).join(short, "slot").withColumn("sequence_id", F.col("bin")).collect()
    assert sorted(r.slot for r in got) == list(range(4000))
    assert check_places(got) <= -(-sum(sizes) // 1024) + 4
