"""Token ids as files of shuffled planes.

Documents in ascending doc_id order form one stream of ids, cut into shards (one per task) and blocks of a fixed number
of ids. A block is transposed into byte or bit planes, and each plane is compressed with zstandard. The row of a block
also holds its part of the index: which documents lie in it, and where. Shards are Parquet tables with one row a block,
so that Spark can write and read them wherever it can write and read tables, and the index is read without the planes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import filterfalse, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import ids_and_text, kept, real_id, tidy

BLOCK = 1 << 16
MAGIC = b"PLN1"
#: A worker remembers the ids of so many words at most that it has met lately, and of as many that it had met before these.
REMEMBERED = 500_000
#: Characters of texts that are encoded together.
GROUP = 1 << 21
#: Words that the tokenizer's model gets at once.
RUN = 1 << 12


BLANKS, MARKS = b" \t\n\v\f\r", b".,;:!?*#$%&()"
#: Kinds of bytes: white space 0, ASCII letters and digits 2, marks 3, others 1.
KINDS = bytes(0 if c in BLANKS else 3 if c in MARKS else 2 if c < 128 and chr(c).isalnum() else 1 for c in range(256))


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts whose ids, joined, are the texts', and the place of each text's first word and of the end. They are cut at ASCII
    white space and between a letter (ASCII or U+00C0 to U+00FF) or ASCII digit and a mark, where the tokenizer cuts, too. It lower-cases by
    itself, so that A-Z may be lower-cased first, but not into special tokens, nor before any of U+0300 to U+037F (first bytes CC and CD):
    only these are composed with ASCII letters, some with one case only."""
    raws = [raw if b"<" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower() for raw in map(str.encode, texts)]
    joined = b" ".join([b"", *raws])  # a blank before each text
    raw, kinds = np.frombuffer(joined, dtype=np.uint8), np.frombuffer(joined.translate(KINDS), dtype=np.uint8)
    solid, letter = kinds > 0, kinds == 2
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | ((kinds[1:] == 3) & letter[:-1])
    data = joined.translate(None, BLANKS)
    places = np.frombuffer((solid + begins.view(np.uint8)).tobytes().translate(None, b"\0"), dtype=np.uint8) == 2
    offsets = np.append(np.flatnonzero(places), len(data))
    firsts = np.searchsorted(np.flatnonzero(begins), np.cumsum([0, *(len(raw) + 1 for raw in raws)]))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), firsts


#: Words of a-z and the letters from U+00C0 to U+00FF. A tokenizer that splits_at_spaces only lower-cases such a word before its model sees
#: it, with each byte as one character.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = np.arange(256, dtype="<u2")
BYTE_LEVEL[sorted(set(range(256)) - set(PRINTED))] = np.arange(256, 512 - len(PRINTED))
BYTE_LEVEL[0x20] = 0x20  # stands between words


#: How word_bpe_49k prepares a text.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file says that it prepares texts as word_bpe_49k does, so that words_of is exact for it."""
    normalizer, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, parts = normalizer.get("normalizers", []), before.get("pretokenizers", [])
    if [x["type"] for x in steps] != NORMALIZERS or [x["type"] for x in parts] != ["Split", "ByteLevel"] or spec.get("post_processor"):
        return False
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or not all("<" in t["content"] for t in spec.get("added_tokens") or []):
        return False
    replaces = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    splits = parts[0]["pattern"] == {"Regex": SPLIT} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    return bool(replaces and splits and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"])


def closing(spec: dict) -> np.ndarray | None:
    """Which ids end a word of LETTERS, for a tokenizer that splits_at_spaces; None if its file doesn't say so of each last character."""
    model = spec["model"]
    suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
    letters = map(chr, BYTE_LEVEL[[*range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), 0xC3]].tolist())
    if not suffix or model.get("ignore_merges") or not all(c in vocab and c + suffix in vocab for c in letters):
        return None
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    return ends


class WordEncoder:
    """Encodes texts with the tokenizers library. Where the tokenizer splits at white space before anything else and drops it, each
    distinct word between ASCII white space is encoded only once; texts of any other tokenizer are encoded whole.
    """

    def __init__(self, source: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(source)
        self.tokenizer, self.remembered = Tokenizer.from_str(source), remembered
        self.wordwise = splits_at_spaces(spec)
        self.ends = closing(spec) if self.wordwise else None
        self.prepared = Tokenizer(self.tokenizer.model)  # for words as the model takes them
        self.prepared.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, source: str, remembered: int = REMEMBERED) -> WordEncoder:
        """The encoder that a worker process keeps between tasks."""
        return kept(cls.name(source), lambda: cls(source, remembered))

    @staticmethod
    def name(source: str) -> str:
        return f"encoder-{zlib.crc32(source.encode())}"

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text without special tokens, as little-endian unsigned 32-bit integers. Texts are taken in groups, whose distinct
        words are looked up once and whose new words are encoded together."""
        group: list[str] = []
        size = 0
        for text in texts:
            if not self.wordwise:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield struct.pack(f"<{len(ids)}I", *ids)
                continue
            group.append(text)
            if (size := size + len(text)) >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        words, firsts = words_of(texts)
        coded = words.dictionary_encode()
        found = self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        bounds, data = np.frombuffer(ends, dtype=np.int64)[firsts], memoryview(data or b"")
        return (data[a:b].tobytes() for a, b in pairwise(bounds.tolist()))

    def _found(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, remembered or new."""
        found = list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        missed = [words[k] for k in missing]
        met = dict(zip(missed, map(self.older.get, missed), strict=True)) if self.older else {}
        met.update(self._encoded([w for w in missed if met.get(w) is None]))
        for k, w in zip(missing, missed, strict=True):
            found[k] = met[w]
        if len(self.known) + len(met) > self.remembered:
            self.known, self.older = {}, self.known
        self.known.update(islice(met.items(), self.remembered))
        return found

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word with its ids. Words of letters go to the tokenizer's model as it takes them, many at once: a word's last id is one
        that only ends words."""
        letters, rest = [], words
        if self.ends is not None:
            letters, rest = list(filter(LETTERS.fullmatch, words)), list(filterfalse(LETTERS.fullmatch, words))
        for at in range(0, len(letters), RUN):
            run = letters[at : at + RUN]
            raw = b" ".join(run).decode().lower().encode()
            text = BYTE_LEVEL[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.prepared.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            yield from zip(run, map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            ids = e.ids
            yield w, struct.pack(f"<{len(ids)}I", *ids)


def tokenizer_source(spark: SparkSession, path: str):
    """The tokenizer's file, read once on the driver (a fixed file of under 2 MB) and broadcast."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def to_block(ids: bytes, planes: str = "byte") -> bytes:
    """MAGIC, kind (0 byte, 1 bit), number of ids, number of planes, their sizes, CRC-32 of the ids, then the planes."""
    cells = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    if planes == "bit":
        cells = np.unpackbits(cells, axis=1, bitorder="little")
        parts = [np.packbits(c, bitorder="little").tobytes() for c in np.ascontiguousarray(cells.T)]
    else:
        parts = [c.tobytes() for c in np.ascontiguousarray(cells.T)]
    pack = zstandard.ZstdCompressor(level=3)
    parts = [pack.compress(p) for p in parts]
    head = struct.pack(f"<4sBIB{len(parts)}II", MAGIC, planes == "bit", len(ids) // 4, len(parts), *map(len, parts), zlib.crc32(ids))
    return head + b"".join(parts)


def from_block(block: bytes) -> bytes:
    magic, bit, n, many = struct.unpack_from("<4sBIB", block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    *sizes, crc = struct.unpack_from(f"<{many}II", block, 10)
    at, rows, unpack = 10 + 4 * many + 4, [], zstandard.ZstdDecompressor()
    for size in sizes:
        plane = np.frombuffer(unpack.decompress(block[at : at + size]), dtype=np.uint8)
        rows.append(np.unpackbits(plane, bitorder="little", count=n) if bit else plane)
        at += size
    cells = np.stack(rows, axis=1) if n else np.zeros((0, many), dtype=np.uint8)
    ids = (np.packbits(cells, axis=1, bitorder="little") if bit else cells).tobytes()
    if zlib.crc32(ids) != crc:
        raise ValueError("a block of token ids is damaged")
    return ids


SHARDS = "shard int, block int, n_ids int, doc_nos array<long>, doc_ids array<long>, counts array<int>, payload binary"


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    planes: str = "byte", block: int = BLOCK,
) -> None:
    """Writes the ids of every text, each followed by end_id, in ascending doc_id order to shards under path.

    Null texts count as empty and null identifiers come first; rows that repeat an identifier are written as often,
    in the order of their text's hash. An empty table writes an empty table. Other columns are ignored.
    """
    source, end = tokenizer_source(docs.sparkSession, tokenizer), struct.pack("<I", end_id)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number, doc_no, held, docs_in = TaskContext.get().partitionId(), 0, 0, bytearray(), []
        encoder = WordEncoder.of(source.value)

        def out(n: int) -> pd.DataFrame:
            nonlocal number, docs_in
            row = (shard, number, n, *(list(c) for c in zip(*docs_in, strict=True)), to_block(bytes(held[: 4 * n]), planes))
            number, docs_in = number + 1, []
            del held[: 4 * n]
            return pd.DataFrame([row], columns=["shard", "block", "n_ids", "doc_nos", "doc_ids", "counts", "payload"])

        for batch in batches:
            for doc_id, ids in zip(batch.doc_id, encoder.ids(batch.text), strict=True):
                ids, at = ids + end, 0
                while at < len(ids):
                    part = ids[at : at + 4 * block - len(held)]
                    held += part
                    at += len(part)
                    docs_in.append((doc_no, doc_id, len(part) // 4))
                    if len(held) == 4 * block:
                        yield out(block)
                doc_no += 1
        if held:
            yield out(len(held) // 4)
        tidy(WordEncoder.name(source.value))

    rows = ids_and_text(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ordered.select("doc_id", "text").mapInPandas(encode, SHARDS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """What write_ids wrote, a row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (unsigned; of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids (those bytes)."""
    blocks = spark.read.schema(SHARDS).parquet(path)
    # one row a shard, and a shard is a task of the writer: the table's size is bounded by the number of tasks
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    firsts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                ids, at = from_block(r.payload), 0
                last = len(r.counts) - 1
                for k, (no, doc_id, n) in enumerate(zip(r.doc_nos, r.doc_ids, r.counts, strict=True)):
                    part = ids[4 * at : 4 * (at + n)]
                    whole = 0 < k < last  # the first and last document of a block may go on in another
                    rows.append((r.shard, no, doc_id, r.block, at, n, zlib.crc32(part), None if whole and not with_ids else part))
                    at += n
            yield pd.DataFrame(rows, columns=["shard", "doc_no", "doc_id", "block", "at", "n", "crc", "part"])

    parts = blocks.mapInPandas(decode, "shard int, doc_no long, doc_id long, block int, at long, n long, crc long, part binary")

    @F.pandas_udf("long")
    def crc_of(lists: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(b"".join(x["part"] for x in xs)) for xs in lists], dtype="int64")

    @F.pandas_udf("binary")
    def joined(lists: pd.Series) -> pd.Series:
        return pd.Series([b"".join(x["part"] for x in xs) for xs in lists])

    sizes = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    begins = blocks.select("shard", "block", "n_ids").withColumn("begin", F.coalesce(F.sum("n_ids").over(sizes), F.lit(0))).drop("n_ids")
    placed = parts.join(begins, ["shard", "block"]).withColumn("at", F.col("at") + F.col("begin"))
    columns = ["shard", "doc_id", "at", "n", "crc", *(["part"] if with_ids else [])]
    cut = placed.filter(F.col("part").isNotNull()) if not with_ids else placed
    cut = (
        cut.groupBy("shard", "doc_no", "doc_id")
        .agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
        .withColumn("crc", crc_of("parts"))
    )
    done = cut.withColumn("part", joined("parts")).select(*columns) if with_ids else cut.select(*columns).unionByName(
        placed.filter(F.col("part").isNull()).select(*columns)
    )
    return done.join(F.broadcast(firsts), "shard").select(
        real_id().alias("doc_id"),
        (F.col("first") + F.col("at")).cast("long").alias("start"),
        F.col("n").cast("long").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
        *([F.col("part").alias("ids")] if with_ids else []),
    )
