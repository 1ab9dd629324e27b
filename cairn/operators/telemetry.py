"""Run logs and samplers. Lines come as (run, line_no, line); every window is inside one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.scalars import format_duration, parse_duration, parse_namespace, parse_pydict, parse_unit


def read_result_sheet(rows: DataFrame, datasets: Sequence[str], models: Sequence[str], by: Sequence[str] = ("file",)) -> DataFrame:
    """S4. rows: (by, row_no, dataset, model, text). The dataset stands only on the first row of a block and is filled down; known datasets
    and models stay, the text dict of metrics becomes the map `metrics`."""
    blank = F.when(F.trim("dataset") != "", F.trim("dataset"))
    filled = F.last(blank, ignorenulls=True).over(W.partitionBy(*by).orderBy("row_no").rowsBetween(W.unboundedPreceding, 0))
    t = rows.withColumn("dataset", filled).withColumn("model", F.trim("model")).withColumn("metrics", parse_pydict("text"))
    return t.filter(F.col("dataset").isin(*datasets) & F.col("model").isin(*models)).select(*by, "row_no", "dataset", "model", "metrics")


def read_gpu_samples(df: DataFrame) -> DataFrame:
    """S5. Loose header names and unit suffixes -> used_mib, total_mib, util (null where unreadable); other columns stay."""
    known = {"memory.used": "used_mib", "memory.total": "total_mib", "utilization.gpu": "util"}
    out = []
    for c in df.columns:
        name = c.strip().lower().split(" [")[0].strip()
        out.append(parse_unit(F.col(f"`{c}`")).alias(known[name]) if name in known else F.col(f"`{c}`").alias(name.replace(".", "_")))
    return df.select(*out)


def read_vmstat(lines: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """S6. lines: (by, line_no, line). The last header row above a line ('r b ... id wa ...') names its columns; only lines of as many
    integers stay. Adds cells, a map from column name to number."""
    words = F.split(F.trim("line"), r"\s+")
    header = F.when(F.array_contains(words, "us") & F.array_contains(words, "id"), words)
    above = F.last(header, ignorenulls=True).over(W.partitionBy(*by).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    t = lines.withColumn("_w", words).withColumn("_h", above)
    numbers = F.transform("_w", lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint")))
    t = t.filter(F.size("_w") == F.size("_h")).withColumn("_n", numbers).filter(F.forall("_n", lambda n: n.isNotNull()))
    return t.select(*by, "line_no", F.map_from_arrays("_h", "_n").alias("cells"))


def _filled(value: Column, by: Sequence[str]) -> Column:
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))


def classified(line: Column) -> Column:
    """What a line of a training log is, by the first rule that fits: a struct of kind, number, seconds and text.

    | kind | line |
    | --- | --- |
    | settings | has `Namespace(...)`: text is the line |
    | load | begins `data load time:`, then a number |
    | stop | says `early stop at epoch`, then a whole number |
    | training, testing | says `training complete in` or `testing complete in`, then a duration: seconds |
    | epoch | begins `Epoch`, then two whole numbers with a slash between them; more text may follow |
    | phase | is TRAIN, VAL or TEST: text |
    | bar | a finished progress bar, `100%|... [spent<left, ...]`: seconds spent |
    | metrics | a dict in braces: text |

    Phrases but not `Epoch` and phases are read in any case, with any white space between their words. Other lines have a null kind."""
    s = F.trim(F.regexp_replace(line, r"\s+", " "))
    low = F.lower(s)
    rest = lambda phrase: F.substring(low, F.locate(phrase, low) + len(phrase), F.length(low))
    whole = lambda text: F.regexp_substr(F.ltrim(text), F.lit("^[0-9]+")).try_cast("int")
    done, total = F.trim(F.split_part(F.substring(s, 6, 1000), F.lit("/"), F.lit(1))), F.split_part(s, F.lit("/"), F.lit(2))
    is_epoch = s.startswith("Epoch ") & done.rlike("^[0-9]+$") & whole(total).isNotNull()
    spent = F.trim(F.substring_index(F.substring_index(s, "<", 1), "[", -1))
    rules = [
        ("settings", s.contains("Namespace("), {"text": s}),
        ("load", low.startswith("data load time:"), {"number": F.regexp_substr(F.ltrim(rest("data load time:")), F.lit("^[0-9.]+")).try_cast("double")}),
        ("stop", low.contains("early stop at epoch") & whole(rest("early stop at epoch")).isNotNull(), {"number": whole(rest("early stop at epoch"))}),
        *[(k, low.contains(f"{k} complete in "), {"seconds": parse_duration(rest(f"{k} complete in "))}) for k in ("training", "testing")],
        ("epoch", is_epoch, {"number": done.try_cast("int")}),
        ("phase", s.isin("TRAIN", "VAL", "TEST"), {"text": s}),
        ("bar", s.contains("100%|"), {"seconds": F.when(s.contains("<") & spent.contains(":"), parse_duration(spent))}),
        ("metrics", s.startswith("{") & s.endswith("}"), {"text": s}),
    ]
    kinds = {"number": "double", "seconds": "double", "text": "string"}
    out = F.lit(None)
    for kind, fits, found in reversed(rules):
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), *[found.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])).otherwise(out)
    return out


def log_rows(lines: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Lines with what they are (kind, number, seconds, text), the epoch and phase in force, marker_no (how many markers of any kind came
    before), elapsed seconds of a finished progress bar, metrics."""
    t = lines.select(*by, "line_no", F.trim("line").alias("line"), classified(F.col("line")).alias("what")).select(*by, "line_no", "line", "what.*")
    is_epoch, is_phase = F.col("kind") == "epoch", F.col("kind") == "phase"
    upto = W.partitionBy(*by).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return t.select(
        *by, "line_no", "line", "kind", "number", "seconds", "text",
        _filled(F.when(is_epoch, F.col("number")), by).cast("int").alias("epoch"),
        _filled(F.when(is_epoch, "").when(is_phase, F.col("text")), by).alias("phase"),  # an epoch marker closes the phase
        F.sum(F.when(is_epoch, 1).otherwise(0)).over(upto).alias("epoch_no"),
        F.sum(F.when(is_epoch | is_phase, 1).otherwise(0)).over(upto).alias("marker_no"),
        F.when(F.col("kind") == "bar", F.col("seconds")).alias("elapsed"),
        F.when(F.col("kind") == "metrics", parse_pydict("text")).alias("metrics"),
    )


def bars(rows: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """(by, line_no, epoch_no, epoch, phase, elapsed, role): role is TRAIN or VAL for the first bar after such a marker, TEST, or
    unassigned."""
    t = rows.filter(F.col("elapsed").isNotNull())
    place = F.row_number().over(W.partitionBy(*by, "marker_no").orderBy("line_no"))
    role = F.when(F.col("phase") == "TEST", "TEST").when(F.col("phase").isin("TRAIN", "VAL") & (F.col("_place") == 1), F.col("phase"))
    return t.withColumn("_place", place).select(*by, "line_no", "epoch_no", "epoch", "phase", "elapsed", F.coalesce(role, F.lit("unassigned")).alias("role"))


def parse_training_log(lines: DataFrame, by: Sequence[str] = ("run",)) -> dict[str, DataFrame]:
    """S7. epochs (by, epoch_no, epoch, train_sec, val_sec), metrics (by, epoch, phase, line_no, metrics: the last of each epoch and phase),
    run (by, args, data_load_sec, early_stop, training_sec, testing_sec, test_bar_sec, last_unassigned_sec)."""
    rows = log_rows(lines, by)
    found = bars(rows, by)
    last_of = lambda role: F.max_by(F.when(F.col("role") == role, F.col("elapsed")), F.when(F.col("role") == role, F.col("line_no")))
    epochs = rows.filter(F.col("epoch_no") > 0).select(*by, "epoch_no", "epoch").distinct()
    times = found.filter(F.col("epoch_no") > 0).groupBy(*by, "epoch_no").agg(last_of("TRAIN").alias("train_sec"), last_of("VAL").alias("val_sec"))
    last_bar = found.groupBy(*by).agg(last_of("TEST").alias("test_bar_sec"), last_of("unassigned").alias("last_unassigned_sec"))
    of = lambda kind, c: F.when(F.col("kind") == kind, c if isinstance(c, Column) else F.col(c))
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    run = rows.groupBy(*by).agg(
        latest(of("settings", parse_namespace("text").cast("string"))).alias("args"), latest(of("load", "number")).alias("data_load_sec"),
        latest(of("stop", "number")).cast("int").alias("early_stop"), latest(of("training", "seconds")).alias("training_sec"), first(of("testing", "seconds")).alias("testing_sec"),
    )
    metrics = rows.filter(F.col("metrics").isNotNull() & F.col("phase").isin("VAL", "TEST"))
    metrics = metrics.groupBy(*by, "epoch", "phase").agg(F.max("line_no").alias("line_no"), F.max_by("metrics", "line_no").alias("metrics"))
    return {
        "epochs": epochs.join(times, [*by, "epoch_no"], "left"),
        "metrics": metrics,
        "run": run.join(last_bar, list(by), "left"),
    }


def gpu_summary(samples: DataFrame, by: str = "run") -> DataFrame:
    """A41. Peak used and total MiB, peak GiB and percent, mean and 95th percentile of utilisation."""
    t = samples.groupBy(by).agg(
        F.max("used_mib").alias("peak_used_mib"), F.max("total_mib").alias("total_mib"), F.avg("util").alias("util_mean"), F.percentile("util", 0.95).alias("util_p95")
    )
    return t.select(
        by, "peak_used_mib", "total_mib", (F.col("peak_used_mib") / 1024).alias("peak_gib"),
        (F.try_divide("peak_used_mib", "total_mib") * 100).alias("peak_pct"), "util_mean", "util_p95",
    )


def host_summary(samples: DataFrame, by: str = "run") -> DataFrame:
    """A42. samples: (by, us, sy, wa, id, free in KiB)."""
    free = F.col("free") / 1048576
    return samples.groupBy(by).agg(
        F.count("*").alias("rows"), F.avg("us").alias("us_mean"), F.avg("sy").alias("sy_mean"), F.avg("wa").alias("wa_mean"),
        F.avg("id").alias("id_mean"), F.percentile("id", 0.95).alias("id_p95"), F.avg(free).alias("free_gib_mean"), F.percentile(free, 0.95).alias("free_gib_p95"),
    )


def epoch_breakdown(epochs: DataFrame, run: DataFrame, by: str = "run") -> DataFrame:
    """A43. A row for each epoch and one ALL row for each run: seconds and hh:mm:ss of training and validation, test seconds, number of
    distinct epochs. The ALL row's test time is the test bar, else the last unassigned bar, else the stated one."""
    t = epochs.rollup(by, "epoch").agg(
        F.sum("train_sec").alias("train_sec"), F.sum("val_sec").alias("val_sec"), F.count_distinct("epoch").alias("n_epochs"), F.grouping("epoch").alias("_all")
    ).filter(F.col(by).isNotNull())
    test = run.select(by, F.coalesce("test_bar_sec", "last_unassigned_sec", "testing_sec").alias("test_sec"), "training_sec")
    t = t.join(test, by, "left")
    all_ = F.col("_all") == 1
    train = F.when(all_, F.coalesce("train_sec", "training_sec")).otherwise(F.col("train_sec"))
    return t.select(
        by, F.when(all_, "ALL").otherwise(F.col("epoch").cast("string")).alias("epoch"), train.alias("train_sec"), "val_sec",
        F.when(all_, F.col("test_sec")).alias("test_sec"), F.when(all_, F.col("n_epochs")).alias("n_epochs"),
        format_duration(train.cast("double")).alias("train_hms"), format_duration(F.col("val_sec").cast("double")).alias("val_hms"),
    )


def best_epoch(metrics: DataFrame, run: DataFrame | None = None, by: str = "run", score: str = "f1") -> DataFrame:
    """A44. metrics: (by, epoch, score). The epoch with the best score, the first among equals, and the last epoch; with a run table the
    stated early stop comes before the last epoch."""
    t = metrics.groupBy(by).agg(
        F.max_by("epoch", F.struct(F.col(score), (-F.col("epoch")).alias("e"))).alias("best_epoch"), F.max(score).alias("best_score"), F.max("epoch").alias("last_epoch")
    )
    if run is None:
        return t.withColumnRenamed("last_epoch", "stop_epoch")
    return t.join(run.select(by, "early_stop"), by, "left").select(by, "best_epoch", "best_score", F.coalesce("early_stop", "last_epoch").alias("stop_epoch"))


def tag_run(df: DataFrame, text: str, datasets: dict[str, str], models: Sequence[tuple[str, str]]) -> DataFrame:
    """A45. Adds dataset and model by patterns on lower-case text. Models are tried in order, so the narrower pattern must stand first;
    what nothing matches is ''."""
    low = F.lower(F.col(text))
    pick = lambda pairs: F.coalesce(*[F.when(low.rlike(p), name) for p, name in pairs], F.lit(""))
    return df.withColumns({"dataset": pick(datasets.items()), "model": pick(models)})
