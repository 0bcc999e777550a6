import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoset.llm import packing as M
from chronoset.llm import queries

from .fixtures import SCHEMA, documents, frame


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit(lengths, capacity):
    """Best-fit decreasing, one document at a time: the rooms that are left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def whole(got, capacity):
    """Sequences are numbered without gaps, and each is filled from 0 without gaps, no further than capacity."""
    own = {}
    for x in got:
        own.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(own) == list(range(len(own)))
    for rows in own.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return [capacity - sum(n for _, n in rows) for rows in own.values()]


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_as_good_as_best_fit_one_by_one(spark, capacity):
    r = random.Random(capacity)
    lengths = [r.choice((r.randint(1, capacity), max(1, capacity // 3), 1 + r.randint(1, capacity) // 9)) for _ in range(400)]
    lengths = [min(n, capacity) for n in lengths]
    rows = [(k, n, "x") for k, n in enumerate(lengths)]
    items = spark.createDataFrame(rows, "k long, length int, __note string").repartition(5)
    got = M.pack(items, ["k"], capacity).collect()
    assert sorted((x.k, x.length) for x in got) == [x[:2] for x in rows] and got[0].asDict().keys() == {"k", "length", "__note", "sequence_id", "offset"}
    assert Counter(whole(got, capacity)) == Counter(best_fit(lengths, capacity))
    again = M.pack(items.repartition(3), ["k"], capacity).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_query(spark, tmp_path, reference):
    r = random.Random(8)
    rows = documents(n=80)
    rows += [(2000 + k, " ".join(r.choice(("abc", "Ünï", "12", "<|endoftext|>", "日本")) for _ in range(n)), None, None, 0) for k, n in enumerate((1023, 2000, 1, 700, 5000))]
    rows += [(3000, "word " * 60_000, None, None, 0)] + [(4000 + k, "same text", None, None, 0) for k in range(50)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_best_fit_packing"](spark, str(tmp_path)).collect()
    want, lengths = [], []
    for i, t, *_ in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        parts = [ids[:first], *(ids[k : k + 1024] for k in range(first, len(ids), 1024))]
        start = 0
        for p, part in enumerate(parts):
            want.append((i, p, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
            start += len(part)
        lengths += map(len, parts)
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=str) == sorted(want, key=str)
    assert Counter(whole(got, 1024)) == Counter(best_fit(lengths, 1024))


def test_ids_are_those_of_the_tokenizers_library(reference):
    r = random.Random(2)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}b{chr(c)}{chr(c)}! {chr(c)}" for c in r.sample(points, 20_000) + list(range(0x300))]
    texts += ["", "it's I'LL <|endoftext|> x<|endoftext|>", " \n \t x", "é" * 5000, "a" * 5000, " ".join(r.choice(("don't", "x1", "日本", "\n\n", "  y")) for _ in range(5000))]
    for t, e in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert M.encode(t).tolist() == e.ids
    for most in (1, 7, 50):
        for t in texts[-40:]:
            assert M.encode(t, most).tolist() == M.encode(t).tolist()


def test_odd_items(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.pieces(empty).collect() == []
    got = M.pack(M.pieces(empty).drop("ids"), ["doc_id", "piece"])
    assert got.collect() == [] and got.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset"]
    for bad in (0, 9, None):
        with pytest.raises(ValueError):
            M.pack(spark.createDataFrame([(1, bad)], "k long, length int"), ["k"], 8)
    same = spark.createDataFrame([(None, 3)] * 9, "k long, length int")
    assert len(whole(M.pack(same, ["k"], 8).collect(), 8)) == 5
