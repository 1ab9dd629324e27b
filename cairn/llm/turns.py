"""Places of turns in their conversations, and digests of ordered rows, for keys of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import stored

#: Rows of a key that a running total goes through at a time.
SEGMENT = 4096


def placed(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds pos, from 1: the place of a row among those of its key (a number, not null) by order, nulls first. Rows are dealt by ranges of
    key and order, so that many tasks number a large key; what the ranges before hold of it is added."""
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    t = stored(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = t.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    split = sizes.groupBy(key).agg(F.collect_list(F.struct("_range", "_n")).alias("_parts")).filter(F.size("_parts") > 1)
    split = split.select(key, F.inline("_parts")).withColumn("_before", before).filter("_before is not null").drop("_n")
    here = F.row_number().over(W.partitionBy("_range", key).orderBy(*by))
    # a key goes on in the next range at most once for each range: fewer rows than tasks
    out = t.withColumn("pos", here.cast("long")).join(F.broadcast(split), [key, "_range"], "left")
    return out.withColumn("pos", F.col("pos") + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def before(rows: DataFrame, key: str, order: str, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds, for each name of totals (an aggregate function's name and what a key without earlier rows gets: ("sum", 0) or ("bit_xor", 0)
    of the column name), before_name: the total over the key's rows before this one by order, a number from 0 on. Segments of rows are
    summed each by itself and then one after the other."""
    t = rows.withColumn("_segment", F.floor(F.col(order) / SEGMENT).cast("long"))
    inner = W.partitionBy(key, "_segment").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(key).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    call = lambda name, c: F.call_function(totals[name][0], F.col(c))
    whole = t.groupBy(key, "_segment").agg(*[call(n, n).alias(n) for n in totals])
    whole = whole.select(key, "_segment", *[call(n, n).over(across).alias(f"_{n}") for n in totals]).filter("_segment > 0")
    t = t.withColumns({f"before_{n}": F.coalesce(call(n, n).over(inner), F.lit(zero)) for n, (_, zero) in totals.items()})
    t = t.join(whole, [key, "_segment"], "left")
    add = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    return t.withColumns({f"before_{n}": add[f](F.col(f"before_{n}"), F.coalesce(f"_{n}", F.lit(zero))) for n, (f, zero) in totals.items()}).drop(
        "_segment", *[f"_{n}" for n in totals]
    )


def digest(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn."""
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def ordered_sha256(rows: DataFrame, keys: Sequence[str], order: str, piece: str, sep: str) -> DataFrame:
    """(keys, sha256): lower-case SHA-256 of a key's pieces, in order, with sep between them. A digest has to see its pieces one after
    the other, so a key's sorted pieces stream through one task, which holds none of them. Keys and pieces aren't null."""
    keys = list(keys)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for *key, text in zip(*(batch[k].tolist() for k in keys), batch["_piece"], strict=True):
                if key == now:
                    state.update(sep.encode())
                else:
                    if state:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(text.encode())
            yield pd.DataFrame(done, columns=[*keys, "sha256"])
        if state:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*keys, "sha256"])

    dealt = rows.select(*keys, F.col(order).alias("_order"), F.col(piece).alias("_piece")).repartition(*keys).sortWithinPartitions(*keys, "_order")
    kinds = dict(rows.dtypes)
    return dealt.drop("_order").mapInPandas(stream, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sha256 string")
