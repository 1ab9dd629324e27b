"""Byte-level BPE by distinct words, against the tokenizers library on whole texts."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import bpe, queries

SF = "/root/testdata/sf0.001"
HARD = [
    (None, "a b"), (None, None), (1, ""), (1, ""), (2, "<|endoftext|> x<|endoftext|>\n\n y  <|endoftext|>  "),
    (3, "a\x1cb\x1d ² ½ Ⅷ 一二三 x²y 5² é 's 'S don't we'll\x85\xa0 z　w  \t\n  tail   "), (4, "w" * 30000), (5, " \n \n"),
    (6, "\U0001f469‍\U0001f469 مرحبا שלום 𝟘𝟙 ① ˣ ª º ٣٤ ௧௨ ੧"), (7, " a​b c﻿d᠎e"), (8, "".join(chr(c) + "x" for c in range(1, 0x3100))),
    (9, "''s'' _a_ __ a_b 1_2 _1 'LL 'll 're've"), (10, " ".join(f"word{i}" for i in range(20_000))),
]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def of(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False)

    return of


@pytest.mark.parametrize("block", [1, 2000, bpe.BLOCK])
def test_encode_as_the_library_does(spark, whole, block):
    df = spark.createDataFrame(HARD, "doc_id long, text string").withColumns({"block": F.lit("x"), "ids": F.lit(1)})
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode(df, queries.byte_bpe(), with_text=True, block=block).collect())
    assert got == sorted((str(d), len(whole(t)[0]) // 4, *whole(t)) for d, t in HARD)


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(map(tuple, bpe.encode(df, queries.byte_bpe()).collect())) == [(1, 0, b""), (2, 0, b"")]
    assert bpe.encode(df.limit(0), queries.byte_bpe(), with_text=True).count() == 0


def test_decode_any_ids(spark, whole):
    rows = [(1, struct.pack("<3I", 0, 50256, 9_999_999)), (2, None), (3, whole("é")[0][:4]), (4, b"")]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id int, ids binary"), queries.byte_bpe())
    assert {r.doc_id: r.decoded for r in got.collect()} == {1: "!<|endoftext|>", 2: None, 3: whole("é")[1] if len(whole("é")[0]) == 4 else "�", 4: ""}


def test_query(spark, whole):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_bpe(spark, SF).collect()}
    want = {}
    for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect():
        ids, text = whole(r.text)
        want[r.doc_id] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got == want


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Words(open(queries.word_bpe(), encoding="utf-8").read())
