"""Byte-level BPE by a table of distinct words.

Texts are cut into words where the tokenizer cuts. A block of texts keeps its distinct words once, and its texts as
positions in that list. The lists are dealt by the words' hash, so that all blocks' copies of a word meet in one place,
where it is encoded once; ids go back to the blocks and are joined to the texts by position. Ids become text again
through a join with the vocabulary's pieces, a table of fixed size. A word can come from each block only once, so no word
is hot, however often it occurs.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ids_and_text, real_id, stored, tidy
from cairn.llm.tokens import from_block, to_block, tokenizer_source

#: Characters of texts that share a list of words (a longer text is a block by itself).
BLOCK = 1 << 25
#: Words whose ids a task holds at once; beyond them a word may be encoded again.
HELD = 400_000
#: Texts are given out when they hold so many ids.
OUT = 1 << 20

#: The words of a byte-level tokenizer, for characters on whose kind Python agrees with it.
WORD = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
KINDS = {"letter": ("a", re.compile(r"[^\W\d_]")), "number": ("1", re.compile(r"\d")), "mark": ("!", re.compile(r"[^\s\w]|_"))}
#: No UTF-8 text holds this byte.
GAP = b"\xff"


class Words:
    """Cuts texts into the words of a byte-level tokenizer given by its file's contents."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(source)
        first, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        if not plain or spec.get("normalizer") or spec.get("post_processor") or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("not a plain byte-level tokenizer")
        self.tokenizer = Tokenizer.from_str(source)
        self.special = re.compile(f"({'|'.join(re.escape(x['content']) for x in sorted(added, key=lambda x: -len(x['content'])))})") if added else None
        self.agreed: set[str] = set()
        self.odd: set[str] = set()

    def _agrees(self, c: str) -> bool:
        """Whether Python's patterns take a character for what the tokenizer takes it for."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        theirs = next((k for k, (x, _) in KINDS.items() if len(cut(x + c + x)) == 1), "space")
        return theirs == next((k for k, (_, x) in KINDS.items() if x.match(c)), "space")

    def _cut(self, text: str) -> list[str]:
        known = set(text)
        if not known <= self.agreed:
            for c in known - self.agreed - self.odd:
                (self.agreed if self._agrees(c) else self.odd).add(c)
            if known & self.odd:
                return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return WORD.findall(text)

    def of(self, text: str) -> list[str]:
        """The words; joined they give the text. Added tokens stand alone."""
        if not self.special or not self.special.search(text):
            return self._cut(text)
        parts = self.special.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._cut(part))]


def _ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _blocks(docs: DataFrame, source, slices: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """One row a block: its texts as positions in the list of its distinct words, that list in slices by the words' hash, and which word is
    in which slice."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, task, no = Words(source.value), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3)

        def fresh() -> tuple:
            at: defaultdict[str, int] = defaultdict()
            at.default_factory = at.__len__
            return at, [], [], 0

        def out(at: dict, places: list, ids: list) -> pd.DataFrame:
            nonlocal no
            sizes = [len(p) for p in places]
            places = np.concatenate(places)
            often = np.argsort(-np.bincount(places, minlength=len(at)), kind="stable")  # frequent words get small numbers, which pack well
            number = np.empty(len(at), dtype="<u4")
            number[often] = np.arange(len(at), dtype="<u4")
            raw = [w.encode() for w in at]
            raw = [raw[i] for i in often.tolist()]
            owner = np.fromiter((zlib.crc32(w) % slices for w in raw), dtype="<u4", count=len(raw))
            order = np.argsort(owner, kind="stable")
            numbers, begins = np.unique(owner[order], return_index=True)
            edges, order = pairwise([*begins.tolist(), len(raw)]), order.tolist()
            held = [(int(s), pack.compress(GAP.join(map(raw.__getitem__, order[a:b])))) for s, (a, b) in zip(numbers, edges, strict=True)]
            row = (task << 33 | no, ids, sizes, to_block(number[places].tobytes()), to_block(owner.tobytes()), held)
            no += 1
            return pd.DataFrame([row], columns=["block", "doc_ids", "n_words", "places", "owners", "slices"])

        at, places, ids, size = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                own = words.of(text)
                places.append(np.fromiter(map(at.__getitem__, own), dtype=np.uint32, count=len(own)))
                ids.append(doc_id)
                size += len(text)
                if size >= block:
                    yield out(at, places, ids)
                    at, places, ids, size = fresh()
        if ids:
            yield out(at, places, ids)
        tidy()

    schema = "block long, doc_ids array<long>, n_words array<long>, places binary, owners binary, slices array<struct<slice: int, words: binary>>"
    return ids_and_text(docs, id_col, text_col).mapInPandas(cut, schema)


def _coded(blocks: DataFrame, source) -> DataFrame:
    """(block, slice, sizes, ids): the ids of a slice's words, one word after the other. Slices of one number lie in one partition, one
    after the other, so that each of their words is encoded once."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, unpack = Words(source.value).tokenizer, zstandard.ZstdDecompressor()
        known, now = {}, None
        for batch in batches:
            rows = []
            for block, number, raw in zip(batch.block, batch["slice"], batch.words, strict=True):
                words = unpack.decompress(raw).split(GAP)
                if number != now or len(known) > HELD:
                    known, now = {}, number
                new = [w for w in words if w not in known]
                for w, e in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                    known[w] = _ids_bytes(e.ids)
                ids = [known[w] for w in words]
                rows.append((block, number, to_block(np.fromiter(map(len, ids), dtype="<u4", count=len(ids)).tobytes()), to_block(b"".join(ids))))
            yield pd.DataFrame(rows, columns=["block", "slice", "sizes", "ids"])
        tidy()

    dealt = blocks.select("block", F.inline("slices")).repartition("slice").sortWithinPartitions("slice", "block")
    return dealt.mapInPandas(encode, "block long, slice int, sizes binary, ids binary")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """Rows (doc_ids, n_words, places, owners, parts) -> identifiers and ids of texts, a bounded number of ids at a time."""
    for batch in batches:
        for doc_ids, n_words, places, owners, parts in zip(*(batch[c] for c in ("doc_ids", "n_words", "places", "owners", "parts")), strict=True):
            table: list[bytes] = []
            for part in sorted(parts, key=lambda p: p["slice"]):
                ids, ends = from_block(part["ids"]), np.cumsum(np.frombuffer(from_block(part["sizes"]), dtype="<u4"), dtype=np.int64).tolist()
                table += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            by_number = np.empty(len(table), dtype=object)
            by_number[np.argsort(np.frombuffer(from_block(owners), dtype="<u4"), kind="stable")] = table
            table = by_number.tolist()
            at, own = 0, np.frombuffer(from_block(places), dtype="<u4")
            names, held, size = [], [], 0
            for doc_id, n in zip(doc_ids, n_words, strict=True):
                names.append(doc_id)
                held.append(b"".join(map(table.__getitem__, own[at : at + n].tolist())))
                at += n
                size += len(held[-1]) >> 2
                if size >= OUT:
                    yield names, held
                    names, held, size = [], [], 0
            if names:
                yield names, held


def _texts(ids: list[bytes], pieces: list[bytes]) -> list[str]:
    """Each id is joined to its piece; what isn't UTF-8 then becomes the replacement character. Unknown ids have no piece."""
    return [b"".join(map(pieces.__getitem__, np.minimum(np.frombuffer(x, dtype="<u4"), len(pieces) - 1).tolist())).decode("utf-8", "replace") for x in ids]


def pieces_of(source: str) -> list[bytes]:
    """The bytes that each id stands for, and nothing for one more id. A piece is spelt in an alphabet of printable characters: a byte
    that is one in Latin-1 stands for itself, the others follow from U+0100 on in their order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    spec = json.loads(source)
    vocabulary = {**spec["model"]["vocab"], **{x["content"]: x["id"] for x in spec.get("added_tokens", [])}}
    pieces = [b""] * (max(vocabulary.values()) + 2)
    for piece, i in vocabulary.items():
        pieces[i] = bytes(map(byte_of.__getitem__, piece)) if all(c in byte_of for c in piece) else piece.encode()
    return pieces


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, as the tokenizers library gives them without
    special tokens) and, if asked for, decoded: what the ids stand for, special tokens included.

    tokenizer: the file of a byte-level BPE that neither normalises nor adds blanks; strings of its added tokens in a text become
    these tokens. Null texts count as empty and have no ids; null and repeated identifiers are kept as they are. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = tokenizer_source(spark, tokenizer)
    slices = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(_blocks(docs, source, slices, id_col, text_col, block), "bpe-blocks")
    coded = _coded(blocks, source).groupBy("block").agg(F.collect_list(F.struct("slice", "sizes", "ids")).alias("parts"))  # one block's words

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(source.value) if with_text else []
        for names, ids in _joined(batches):
            out = {"doc_id": names, "n_tokens": [len(x) >> 2 for x in ids], "ids": ids}
            yield pd.DataFrame({**out, "decoded": _texts(ids, pieces)} if with_text else out)
        tidy()

    # texts that are all empty have no words, and their block has no row in coded
    rows = blocks.drop("slices").join(coded, "block", "left")
    rows = rows.select("doc_ids", "n_words", "places", "owners", F.coalesce("parts", F.array().cast(coded.schema["parts"].dataType)).alias("parts"))
    out = rows.mapInPandas(assemble, "doc_id long, n_tokens long, ids binary" + ", decoded string" * with_text)
    return out.withColumn("doc_id", real_id())


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded, the text that ids_col (as encode gives it) stands for. Null ids give null; ids that the tokenizer doesn't have
    stand for nothing."""
    source = tokenizer_source(encoded.sparkSession, tokenizer)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = pieces_of(source.value)
        for batch in batches:
            yield pd.Series([None if x is None else _texts([x], pieces)[0] for x in batch], dtype=object)

    return encoded.withColumn("decoded", text(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and lower-case SHA-256 of the ids and of the decoded text."""
    t = encode(docs, tokenizer, id_col, text_col, with_text=True)
    return t.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
