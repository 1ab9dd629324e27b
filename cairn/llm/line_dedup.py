"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Lines with equal sets are reduced to the first of them, by (doc_id, line
number); then every line that has an earlier one with a Jaccard similarity of at least `least` is removed. Words are
ordered by rarity, so that similar lines share a word of their short prefixes; under a shared word the place and length
filters and a 128-bit parity sketch of the set rule out nearly all other pairs, and the rest are verified on the words
themselves.

Where many lines share a word they are first searched in parts; most lines of a large group of copies find a similar one
there. If those that don't are so few that they can be held against all others under the word, they are. Otherwise keys are
made longer: similar but unequal sets share four words at least, so prefixes longer by a word share two words, longer by
two words three, and so on, and lines under a common word meet under each of the words that follow it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import words as w
from cairn.llm.common import bit_table, cell_counts, has_bit, ids_and_text, let, row_keys, scratch, split_by_key, stored, tidy

#: Cells of the table of word counts: words share a cell by hash, which only affects their order. It is what is broadcast.
CELLS = 1 << 20
#: Lines under one key that are compared with each other, and, where a key has more, pairs for each of its rows that are looked at before
#: keys are made longer.
BLOCK, PAIRS_A_ROW = 4096, 500
#: Words of the longest key: similar sets that aren't equal share as many at least (4 of 5 words at a similarity of 0.8).
DEPTH = 4
#: Bits of the table of the lines whose words are wanted for verification; a bit that several lines share costs time only.
BITS = 1 << 25
#: Lines that a task looks at together for equal ones, rows and pairs that it compares in one go.
AT_ONCE, TOGETHER, MOST_PAIRS = 100_000, 200_000, 4_000_000
#: Rows of a few numbers that are broadcast at most.
FEW = 200_000
SLACK = 1e-9


def words_of(line: str) -> list[bytes]:
    return line.lower().encode("utf-8", "surrogatepass").split()


def prefix_size(size, least: float):
    """Words of a prefix: sets of `size` words that are similar to another share one of them."""
    return size - np.ceil(least * size - SLACK).astype(np.int64) + 1


def depth(least: float) -> int:
    """Words that similar sets share at least if they aren't equal."""
    return max(1, min(DEPTH, ceil(least / (1 - least) - SLACK))) if least < 1 else 1


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often the words of each cell occur in all documents."""

    def cells_of(texts: pd.Series) -> Iterator[np.ndarray]:
        for group in w.groups(texts):
            yield (w.words(w.lower_bytes(group))[0] & np.uint64(CELLS - 1)).astype(np.int64)

    return cell_counts(docs.select("text"), CELLS, cells_of)


LINES = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("size", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("words", pa.binary())]
)
LINES_SQL = "a long, b long, doc_id long, line_no int, size int, low long, high long, words binary"


def packed(flat: np.ndarray, many: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers, `many` in each, as binary values."""
    ends = np.r_[0, np.cumsum(many) * 4].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def unpacked(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each value has)."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    if not len(values):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return np.frombuffer(flat.tobytes(), dtype=np.int32), np.diff(ends) // 4


def line_sets(data: bytes, rank: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For some of the lines of data at a time, those with words: number, digest of the set (a, b), size, sketch (low, high), number of
    words that follow, and the rarest words of all of them, one line after the other."""
    codes, line = w.words(data)
    if not len(line):
        return
    cut = np.searchsorted(line, np.arange(0, int(line[-1]) + 1, 1 << 14)).tolist()
    for lo, hi in zip(cut, [*cut[1:], len(line)], strict=True):
        if lo == hi:
            continue
        c, n = codes[lo:hi], line[lo:hi]
        # line, rarity and more of the hash in one number, so that one sort puts equal words together and rare ones first
        key = (n & ((1 << 14) - 1)).astype(np.uint64) << np.uint64(50) | rank[(c & np.uint64(CELLS - 1)).astype(np.int64)] << np.uint64(30) | c >> np.uint64(34)
        order = np.argsort(key)
        c, n = c[order], n[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (n[1:] != n[:-1])]
        c, n = c[new], n[new]
        start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        size = np.diff(np.r_[start, len(n)])
        # parity of the words at each of 128 places: sets that differ in d words differ in at most d bits
        at = w.mixed(c, 2) & np.uint64(127)
        bit = np.uint64(1) << (at & np.uint64(63))
        low, high = (np.bitwise_xor.reduceat(np.where(at >> np.uint64(6) == half, bit, np.uint64(0)), start).view(np.int64) for half in (0, 1))
        a, b = np.add.reduceat(w.mixed(c, 3), start), np.add.reduceat(w.mixed(c, 4), start)
        many = np.minimum(size, prefix_size(size, least) + depth(least) - 1)
        at = np.repeat(start - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        yield n[start], a.view(np.int64), b.view(np.int64), size, low, high, many, (c[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def firsts_of(a: np.ndarray, b: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by digest, doc_id and line number; whether a row in that order is, or equals, the first of its digest)."""
    order = np.lexsort((line, doc, b, a))
    a, b, doc, line = a[order], b[order], doc[order], line[order]
    run = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, dtype=bool)
    head = np.flatnonzero(run)[np.cumsum(run) - 1]
    return order, (doc == doc[head]) & (line == line[head])


def all_lines(docs: DataFrame, rank, least: float) -> DataFrame:
    """A row for each line with words, as LINES. size is 0 and words are empty if an equal line before it has been seen; its digest
    is then replaced by another, so that many equal lines don't meet. And a row for each document with line number -1 and
    minus its number of lines as size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, at = batch.column("doc_id").to_numpy(), 0
            for group in w.groups(batch.column("text").to_pylist()):
                lines = np.array([t.count("\n") + 1 for t in group])
                begin, here = np.r_[0, np.cumsum(lines)[:-1]], ids[at : at + len(group)]
                digest, none = w.mixed(here.view(np.uint64), 9).view(np.int64), np.zeros(len(group), dtype=np.int64)
                held.append((here, np.full(len(group), -1, dtype=np.int32), digest, none, -lines, none, none, none, np.zeros(0, dtype=np.int32)))
                n += len(group)
                for no, *rest in line_sets(w.lower_bytes(group), rank.value, least):
                    text = np.searchsorted(begin, no, side="right") - 1
                    held.append((ids[at + text], (no - begin[text]).astype(np.int32), *rest))
                    n += len(no)
                    if n >= AT_ONCE:
                        yield combined(held)
                        held, n = [], 0
                at += len(group)
        if held:
            yield combined(held)
        tidy()

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        doc, line, a, b, size, low, high, many, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first = firsts_of(a, b, doc, line)
        keep = np.empty(len(doc), dtype=bool)
        keep[order] = first
        own = w.mixed(doc.view(np.uint64) ^ w.mixed(line.astype(np.uint64), 5), 6).view(np.int64)
        a = np.where(keep, a, own)
        flat, many = flat[np.repeat(keep, many)], np.where(keep, many, 0)
        columns = [a, b, doc, line, np.where(keep, size, 0).astype(np.int32), low, high]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), packed(flat, many)], schema=LINES)

    return docs.mapInArrow(run, LINES_SQL)


def in_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Some batches together at a time, cut where the column `key` changes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            whole = pa.Table.from_batches(held)
            keys = whole.column(key).to_numpy()
            tail = int((keys == keys[-1]).argmax())
            if tail:
                yield whole.slice(0, tail)
                held, n = whole.slice(tail).to_batches(), n - tail
    if n:
        yield pa.Table.from_batches(held)


def first_lines(lines: DataFrame) -> DataFrame:
    """lines with size 0 wherever another row with an equal set comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_groups(batches, 0):
            a, b, doc, line, size = (part.column(k).to_numpy() for k in range(5))
            order, first = firsts_of(a, b, doc, line)
            new = np.empty(len(a), dtype=np.int32)
            new[order] = np.where(first, size[order], 0)
            out = part.set_column(4, "size", pa.array(new)).select(["doc_id", "line_no", "size", "low", "high", "words"])
            yield from out.to_batches()

    ordered = lines.repartition("a", "b").sortWithinPartitions("a")
    return ordered.mapInArrow(run, "doc_id long, line_no int, size int, low long, high long, words binary")


def few(df: DataFrame) -> DataFrame:
    """A stored table of few columns, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def common_cells(sets: DataFrame, least: float, block: int) -> DataFrame | None:
    """(cell) of the cells that more than `block` prefix words fall in. Only their words can have that many lines. None if these
    are many."""

    def cells_of(words: pd.Series) -> Iterator[np.ndarray]:
        for at in range(0, len(words), AT_ONCE):
            flat, many = unpacked(pa.array(words.iloc[at : at + AT_ONCE], type=pa.binary()))
            size = many - depth(least) + 1  # at least the prefix: short sets keep no more than they have
            place = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
            yield flat[place < np.repeat(np.maximum(size, 1), many)].astype(np.int64) & (CELLS - 1)

    prefix = sets.select("words")
    cells = np.flatnonzero(cell_counts(prefix, CELLS, cells_of) > block)
    if len(cells) > FEW:
        return None
    return sets.sparkSession.createDataFrame(pd.DataFrame({"cell": cells.astype(np.int32)}), "cell int")


ROWS = [("key", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("size", pa.int32()), ("place", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]
ROWS_SQL = "key long, doc_id long, line_no int, size int, place int, low long, high long"


def key_bit(key: np.ndarray) -> np.ndarray:
    return (w.mixed(key.astype(np.int64).view(np.uint64), 11) & np.uint64(BITS - 1)).astype(np.int64)


def key_bits(rows: DataFrame) -> Broadcast:
    """A table of BITS bits of the rows' keys, broadcast."""

    def bits_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"bit": key_bit(x.key.to_numpy())})

    return rows.sparkSession.sparkContext.broadcast(bit_table(rows.select("key").mapInPandas(bits_of, "bit long"), BITS))


def keyed(source: DataFrame, least: float, k: int, with_words: bool = False, wanted: Broadcast | None = None) -> DataFrame:
    """Rows of lines under keys of k + 1 words, as ROWS (and words); source: sets, or, for k > 0, rows under keys of k words with words,
    which get each of the words that may follow. size - place + k is how many words a line may share with others at most, if
    the key's are the first of them. wanted: key_bits; rows under other keys may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                flat, many = unpacked(batch.column("words"))
                size = batch.column("size").to_numpy().astype(np.int64)
                first = batch.column("place").to_numpy().astype(np.int64) + 1 if k else np.zeros(len(size), dtype=np.int64)
                n = np.maximum(np.minimum(prefix_size(size, least) + k, many) - first, 0)  # line_sets keeps as many words
                row = np.repeat(np.arange(len(size)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
                key = flat[(np.cumsum(many) - many)[row] + place].astype(np.int64)
                if k:
                    key = w.mixed(batch.column("key").to_numpy()[row].view(np.uint64) ^ w.mixed(key.view(np.uint64), 10 + k), 20 + k).view(np.int64)
                if wanted is not None:
                    may = np.flatnonzero(has_bit(wanted.value, key_bit(key)))
                    row, place, key = row[may], place[may], key[may]
                take = pa.array(row)
                doc, line, low, high = (batch.column(c).take(take) for c in ("doc_id", "line_no", "low", "high"))
                columns = [pa.array(key), doc, line, pa.array(size[row].astype(np.int32)), pa.array(place.astype(np.int32)), low, high]
                names = [name for name, _ in ROWS]
                if with_words:
                    columns, names = [*columns, batch.column("words").take(take)], [*names, "words"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    before = ["key", "place"] if k else []
    return source.select(*before, "doc_id", "line_no", "size", "low", "high", "words").mapInArrow(run, ROWS_SQL + ", words binary" * with_words)


def common_keys(rows: DataFrame, sets: DataFrame | None, least: float, block: int) -> DataFrame:
    """(key, n) of the keys of more than `block` rows, stored. sets: where the rows' keys are their words."""
    keys = rows.select("key")
    if sets is not None and (cells := common_cells(sets, least, block)) is not None:
        keys = keys.withColumn("cell", F.col("key").bitwiseAND(CELLS - 1).cast("int")).join(F.broadcast(cells), "cell")
    return stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "common")


def line_bit(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (w.mixed(doc.astype(np.int64).view(np.uint64) ^ w.mixed(line.astype(np.uint64), 7), 8) & np.uint64(BITS - 1)).astype(np.int64)


def best(j: np.ndarray, i: np.ndarray, apart: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair of each j that differs least; more[j] is set where it has others."""
    order = np.lexsort((i, apart, j))
    j, i, apart = j[order], i[order], apart[order]
    new = np.r_[True, j[1:] != j[:-1]] if len(j) else np.zeros(0, dtype=bool)
    more[j[~new]] = True
    return j[new], i[new], apart[new]


def pairs_in(
    group: np.ndarray, doc: np.ndarray, line: np.ndarray, size: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (j, i) of rows of one group, i the earlier line, that can be similar: of each j the one whose sketch differs least; in how
    many bits; and whether j has others. group: numbers that don't fall.

    Places are judged as if no word before them were common: similar lines are found under the first words that they share.
    Then all that they share stands from there on, so that u >= size must hold both ways. The rows are held against
    themselves moved on by 1, 2, ... places, and groups that are too small for a move drop out."""
    n = len(group)
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    many = np.diff(np.r_[new, n])
    rows, g, many = np.arange(n), np.repeat(np.arange(len(new)), many), np.repeat(many, many)
    s, u = size.astype(np.float64), (size - place) * ((1 + least) / least) - size + 1e-6
    more = np.zeros(n, dtype=bool)
    found, held, e = [(rows[:0], rows[:0], rows[:0])], 0, 1

    def reduced() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [best(*(np.concatenate(x) for x in zip(*found, strict=True)), more)]

    while len(rows) > e:
        large = many > e
        if large.mean() < 0.8:
            rows, g, many, s, u = (x[large] for x in (rows, g, many, s, u))
            continue
        at = np.flatnonzero((u[e:] >= s[:-e]) & (u[:-e] >= s[e:]) & (g[e:] == g[:-e]))
        j, i = rows[at + e], rows[at]
        both = size[i] + size[j]
        apart = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j])
        ok = both - apart >= 2 * np.ceil(both * (least / (1 + least)) - SLACK)
        j, i, apart = j[ok], i[ok], apart[ok]
        turn = (doc[j] < doc[i]) | (doc[j] == doc[i]) & (line[j] < line[i])
        same = (doc[j] == doc[i]) & (line[j] == line[i])  # two words of a line may share their 32 bits
        found.append((np.where(turn, i, j)[~same], np.where(turn, j, i)[~same], apart[~same]))
        if (held := held + len(j)) > MOST_PAIRS:
            found = reduced()
            held = len(found[0][0])
        e += 1
    j, i, apart = reduced()[0]
    return j, i, apart, more[j]


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("line_no", pa.int32()), ("apart", pa.int32()), ("to_doc", pa.int64()), ("to_line", pa.int32()), ("more", pa.bool_())]
)
FOUND_SQL = "doc_id long, line_no int, apart int, to_doc long, to_line int, more boolean"


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """rows: key, doc_id, line_no, size, place, low, high, whole. For lines with earlier ones under a key that may be similar the one that
    differs least, and whether there are others, as FOUND. Where a key's rows aren't its whole group, there may always be others."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_groups(batches, 0):
            key, doc, line, shape, low, high = (part.column(k).to_numpy() for k in range(6))
            group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
            j, i, apart, more = pairs_in(group, doc, line, shape >> 32, (shape & 0xFFFFFFFF) >> 1, low.view(np.uint64), high.view(np.uint64), least)
            # of the pairs of a line under several keys the best is enough
            more |= shape[j] & 1 == 0
            order = np.lexsort((line[i], doc[i], apart, line[j], doc[j]))
            j, i, apart, more = j[order], i[order], apart[order], more[order]
            new = np.r_[True, (doc[j][1:] != doc[j][:-1]) | (line[j][1:] != line[j][:-1])] if len(j) else np.zeros(0, dtype=bool)
            start = np.flatnonzero(new)
            if len(start):
                head = start[np.cumsum(new) - 1]
                more = np.logical_or.reduceat(more | (doc[i] != doc[i[head]]) | (line[i] != line[i[head]]), start)
            else:
                more = np.zeros(0, dtype=bool)
            j, i, apart = j[start], i[start], apart[start].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (doc[j], line[j], apart, doc[i], line[i], more))], schema=FOUND)
        tidy()

    rows = rows.select("key", "doc_id", "line_no", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("place") * 2 + F.col("whole").cast("int")).alias("shape"), "low", "high")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(search, FOUND_SQL)


def similar(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """pairs with hit, whether the two lines are similar by their words. Only lines with a wanted bit leave the documents."""

    def bits_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ends = line_bit(x.doc_id.to_numpy(), x.line_no.to_numpy()), line_bit(x.to_doc.to_numpy(), x.to_line.to_numpy())
            yield pd.DataFrame({"bit": np.concatenate(ends)})

    wanted = bit_table(pairs.select("doc_id", "line_no", "to_doc", "to_line").mapInPandas(bits_of, "bit long"), BITS)
    bits = docs.sparkSession.sparkContext.broadcast(wanted)  # BITS bits

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_ = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist()
            many = np.array([t.count("\n") + 1 for t in all_], dtype=np.int64)
            begin = np.r_[0, np.cumsum(many)]
            doc, line = np.repeat(ids, many), np.arange(begin[-1]) - np.repeat(begin[:-1], many)
            bit = line_bit(doc, line)
            at = np.flatnonzero(has_bit(bits.value, bit))
            row = (np.searchsorted(begin, at, side="right") - 1).tolist()
            cut = {r: all_[r].split("\n") for r in set(row)}
            found = pa.array([cut[r][n] for r, n in zip(row, line[at].tolist(), strict=True)], type=pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(line[at].astype(np.int32)), found], names=["doc_id", "line_no", "line"])
        tidy()

    # where few documents have wanted lines, only these are read
    ids = stored(pairs.select(F.explode(F.array("doc_id", "to_doc")).alias("doc_id")).distinct(), "ids")
    if ids.count() <= FEW // 10:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    # rows equal in identifier and text give a line more than once
    lines = stored(docs.mapInArrow(texts, "doc_id long, line_no int, line string").distinct(), "lines")

    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str, q: str) -> bool:
            a, b = set(words_of(p)), set(words_of(q))
            common = len(a & b)
            return common >= least * (len(a) + len(b) - common) - SLACK

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    sides = pairs.join(lines, ["doc_id", "line_no"]).join(
        lines.select(F.col("doc_id").alias("to_doc"), F.col("line_no").alias("to_line"), F.col("line").alias("to")), ["to_doc", "to_line"]
    )
    return sides.select("doc_id", "line_no", check("line", "to").alias("hit"), "more")


def near_lines(sets: DataFrame, docs: DataFrame, least: float, block: int, pairs_a_row: int) -> DataFrame:
    """sets: doc_id, line_no, size, low, high, words of distinct sets. (doc_id, line_no) of those with an earlier similar one."""
    line = ["doc_id", "line_no"]

    def verified(pairs: DataFrame) -> DataFrame:
        """Each line of the pairs once, with hit and more."""
        checked = similar(stored(pairs, "pairs"), docs, least)
        return stored(checked.groupBy(*line).agg(F.max("hit").alias("hit"), F.max("more").alias("more")), "judged")

    def nearest(rows: DataFrame) -> DataFrame:
        """Lines that have candidates, each judged by the one that differs least."""
        to = F.struct("to_doc", "to_line")
        found = candidates(rows, least).groupBy(*line).agg(
            F.min(F.struct("apart", "to_doc", "to_line")).alias("best"), (F.max("more") | (F.min(to) != F.max(to))).alias("more")
        )
        return verified(found.select(*line, "best.to_doc", "best.to_line", "more"))

    def any_of(asking: DataFrame, rows_of: Callable[..., DataFrame], others: DataFrame | None = None) -> DataFrame:
        """Lines of the asking rows that are similar to any earlier line under their keys, among those of rows_of and the others: all pairs
        that may be are verified. Rows under keys that no row asks for don't leave Python."""
        rows = rows_of(wanted=key_bits(asking))
        a, b = few(asking).alias("a"), (rows if others is None else rows.unionByName(others)).alias("b")
        both = F.col("a.size") + F.col("b.size")
        need = F.ceil(both * (least / (1 + least)) - SLACK)
        rest = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
        apart = sum(F.bit_count(F.col(f"a.{half}").bitwiseXOR(F.col(f"b.{half}"))) for half in ("low", "high"))
        earlier = F.struct("b.doc_id", "b.line_no") < F.struct("a.doc_id", "a.line_no")
        met = b.join(a, (F.col("a.key") == F.col("b.key")) & earlier & (rest >= need) & (both - apart >= 2 * need))
        met = met.select(*(F.col(f"a.{c}") for c in line), F.col("b.doc_id").alias("to_doc"), F.col("b.line_no").alias("to_line"))
        return verified(met.distinct().withColumn("more", F.lit(False))).filter("hit").select(*line)

    near, source = [], sets
    for k in range(depth(least)):
        moved = lambda rows, k=k: rows.withColumn("place", F.col("place") - k)
        rows = moved(keyed(source, least, k))
        keys = common_keys(rows, None if k else sets, least, block)
        none = keys.isEmpty()

        def plain_of(source: DataFrame = source, wanted: Broadcast | None = None, k=k, moved=moved, keys=None if none else few(keys)) -> DataFrame:
            """The rows of source's lines under keys that aren't common."""
            rows = moved(keyed(source, least, k, wanted=wanted))
            return rows if keys is None else rows.join(keys, "key", "left_anti")

        common = None if none else stored(moved(keyed(source, least, k, True)).join(few(keys.select("key")), "key"), "rows")
        first = plain_of().withColumn("whole", F.lit(True))
        # rows under common keys are dealt out, and each part is searched by itself
        judged = nearest(first if none else first.unionByName(dealt(common.drop("words"), keys, block)))
        near.append(judged.filter("hit").select(*line))
        left = stored(judged.filter("more and not hit").select(*line), "left")
        again = stored(plain_of(source.join(few(left), line, "left_semi")), "again")
        if none:
            if not again.isEmpty():
                near.append(any_of(again, plain_of))
            break
        # lines under common keys without a hit are held against all others there if these are few pairs; else their keys are made longer
        hits = stored(reduce(DataFrame.unionByName, near).distinct(), "hits")
        asking = stored(common.drop("words").join(hits, line, "left_anti"), "asking")

        def pairs_of(asking: DataFrame, keys: DataFrame = keys) -> int:
            return asking.groupBy("key").agg(F.count("*").alias("m")).join(keys, "key").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0))).first()[0]

        most, last = pairs_a_row * common.count(), k == depth(least) - 1
        many = pairs_of(asking)
        while last and many > most:  # once more among themselves, until that hardly finds any
            found = nearest(dealt(asking, asking.groupBy("key").agg(F.count("*").alias("n")), block)).filter("hit").select(*line)
            near.append(found)
            asking = stored(asking.join(found, line, "left_anti"), "asking")
            before, many = many, pairs_of(asking)
            last = many <= before // 2
        if k == depth(least) - 1 or many <= most:
            asking = stored(again.unionByName(asking), "asking")
            if not asking.isEmpty():
                near.append(any_of(asking, plain_of, common.drop("words")))
            break
        if not again.isEmpty():
            near.append(any_of(again, plain_of))
        source = common.withColumn("place", F.col("place") + k)
    return reduce(DataFrame.unionByName, near).distinct()


def dealt(rows: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """rows with keys that stand for parts of their groups, of about `block` rows each; keys: (key, n)."""
    sizes = few(stored(keys.select("key", F.ceil(F.col("n") / block).cast("long").alias("parts")), "sizes"))
    part = F.pmod(F.xxhash64("doc_id", "line_no"), F.col("parts"))
    return rows.join(sizes, "key").withColumn("key", F.xxhash64("key", part)).drop("parts").withColumn("whole", F.lit(False))


def judged_lines(
    docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, pairs_a_row: int = PAIRS_A_ROW
) -> DataFrame:
    """(doc_id, line_no, near, n_lines), stored: the lines to remove, numbered from 0; near tells lines that are only similar to an
    earlier one from later lines with an equal set. And a row for each document with line number -1 and n_lines, which is
    null otherwise. Identifiers must tell documents apart; null is NULL_ID here and comes first."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = ids_and_text(docs, id_col, text_col)
        order = np.argsort(word_counts(rows), kind="stable")
        rank = np.empty(CELLS, dtype=np.uint64)
        rank[order] = np.arange(CELLS, dtype=np.uint64)
        lines = stored(first_lines(all_lines(rows, spark.sparkContext.broadcast(rank), least)), "sets")  # CELLS numbers
        near = near_lines(lines.filter("size > 0"), rows, least, block, pairs_a_row)
        n_lines = F.when(F.col("size") < 0, -F.col("size"))
        equal = lines.filter("size <= 0").select("doc_id", "line_no", F.lit(False).alias("near"), n_lines.alias("n_lines"))
        near = near.select("doc_id", "line_no", F.lit(True).alias("near"), F.lit(None).cast("int").alias("n_lines"))
        return stored(equal.unionByName(near), "judged", outer=True)


def removed_lines(docs: DataFrame, *args, **more) -> DataFrame:
    """(doc_id, line_no, near) of judged_lines, without the rows of documents."""
    return judged_lines(docs, *args, **more).filter("line_no >= 0").drop("n_lines")


def line_decisions(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_equal (lines removed that equal an earlier one), n_near (that are only similar to
    one), removed (the numbers of both, from 0).

    Blank lines are never removed; null and empty texts are one blank line. Rows that share an identifier, or have none, are
    judged one by one: they come before all others, in no order of meaning. Rows equal in identifier and text share their
    decisions. Other columns are ignored; an empty table gives an empty result.
    """
    rows = row_keys(docs, id_col, text_col)
    removed = F.when(F.col("line_no") >= 0, F.col("line_no"))
    by_key = judged_lines(rows.select("key", "text"), least, "key", "text").groupBy(F.col("doc_id").alias("key")).agg(
        F.max("n_lines").alias("n_lines"),
        F.count(F.when(~F.col("near"), removed)).cast("int").alias("n_equal"),
        F.count(F.when(F.col("near"), removed)).cast("int").alias("n_near"),
        F.array_sort(F.collect_set(removed)).alias("removed"),
    )
    ids = rows.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "key")
    return ids.join(stored(by_key, "decisions"), "key").select("doc_id", "n_lines", "n_equal", "n_near", "removed")


def line_dedup(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later lines taken out of the texts; a text may become empty, a null text stays null. All columns stay,
    whatever their names. Rows are judged as by line_decisions; an empty table stays empty."""
    rows = row_keys(docs, id_col, text_col)
    gone = removed_lines(rows.select("key", "text"), least, "key", "text").groupBy(F.col("doc_id").alias("key"))
    gone = stored(gone.agg(F.collect_set("line_no").alias("removed")), "removed")

    def left(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed").cast("array<int>"))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    kept = let(F.split("text", "\n", -1), left)
    new = F.when(F.col("removed").isNotNull(), kept).otherwise(F.col(f"row.`{text_col}`"))
    touched, others = split_by_key(rows, gone)
    touched = touched.join(gone, "key", "left").select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
    return touched.unionByName(others.select("row.*"))
