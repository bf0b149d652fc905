import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from locweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer():
    model, encoder, r = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(4)
    parts = ["ab", "zé", "'s", ".", ",", "Über", "01", "x²", "_", "--", "$", "<|endoftext|>", "中", "\x1c", " ", "\t"]
    gaps = ["", "\n", " ", " ", "  ", " \n"]
    texts = ["".join(r.choice(parts[: 11 if i % 3 else None]) + r.choice(gaps) for _ in range(r.randint(0, 9))) for i in range(6000)] + ["", " ", "\n"]
    for text, got in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert got.tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    model, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["Some words, and more.", "two\nlines of  it", "", "Über 12"]
    for text, got in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert got.tolist() == model.encode(text, add_special_tokens=False).ids


def bins_of(lengths, capacity):
    bins, rows = packing.Bins(capacity, 100), []
    for i, n in enumerate(lengths):
        rows += bins.add(i, 0, np.arange(n, dtype="<u4").tobytes(), n)
    return rows, rows + list(bins.rest())


def test_a_class_takes_a_fixed_number_whole():
    rows, whole = bins_of([3, 3, 3], 8)  # class 2: two pieces and the head of a third
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in rows] == [(0, 0, 3, 100, 0), (1, 0, 3, 100, 3), (2, 0, 2, 100, 6)]
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in whole[3:]] == [(2, 2, 1, 101, 0)]


def test_bins_cover_all_without_padding_and_with_few_cuts():
    r = random.Random(7)
    for capacity, lengths in ((1024, [r.randrange(1, 3000) for _ in range(3000)]), (1024, [r.randrange(1, 60) for _ in range(3000)]), (64, [1, 5, 63, 64, 65, 500] * 9), (8, [])):
        _, rows = bins_of(lengths, capacity)
        seen, filled = {}, {}
        for i, start, n, crc, total, sequence, offset in sorted(rows, key=lambda x: (x[0], x[1])):
            assert start == seen.get(i, 0) and total == lengths[i] and n > 0
            assert crc == zlib.crc32(np.arange(start, start + n, dtype="<u4").tobytes())
            seen[i] = start + n
        assert seen == dict(enumerate(lengths))
        for *_, n, _, _, sequence, offset in sorted(rows, key=lambda x: (x[5], x[6])):
            assert offset == filled.get(sequence, 0)
            filled[sequence] = offset + n
        assert all(n == capacity or n & (n - 1) == 0 for n in filled.values()) and sum(n < capacity for n in filled.values()) <= 10
        # A cut a bin, besides those at whole sequences of long documents.
        assert len(rows) <= len(lengths) + sum(n // capacity for n in lengths) + len(filled)


def test_pieces_cover_texts_without_padding(spark):
    r = random.Random(1)
    texts = [None, "", "short"] + [" ".join("word%d" % r.randrange(999) for _ in range(r.randrange(900))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, "no id"), (2, "short")]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    pieces = packing.pack(frame).toPandas()
    by_sequence = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_sequence.length.cumsum() - pieces.length == pieces.offset).all()
    assert by_sequence.length.sum().map(lambda n: n <= 1024 and n & (n - 1) == 0).all()
    model = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        if i == 2:
            continue
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = pieces[pieces.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine.itertuples())
    assert pieces.doc_id.isna().sum() > 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
