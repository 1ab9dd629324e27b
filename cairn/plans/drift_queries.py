"""Drift between two datasets on the driver's tables: lines with status F against O, documents in English against others."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import describe as D
from cairn.operators import drift as R
from cairn.operators import keys as K
from cairn.plans.base import query, rounded, table

COLS = ["l_quantity", "l_extendedprice", "disc"]
LONG = " UNION ALL ".join(f"SELECT l_linestatus AS dataset, '{c}' AS field, {'nullif(l_discount, 0)' if c == 'disc' else c} AS x FROM lineitem" for c in COLS)
COUNTS = " UNION ALL ".join(f"SELECT CASE WHEN lang = 'en' THEN 'ref' ELSE 'tgt' END AS dataset, '{f}' AS field, {e} AS value, count(*) AS n FROM documents GROUP BY ALL"
                            for f, e in (("source", "source"), ("lang", "lang"), ("size", "CASE WHEN n_chars >= 3000 THEN '__MISSING__' ELSE CAST(n_chars // 500 AS VARCHAR) END")))
ALIGNED = f"al AS (SELECT field, value, CAST(sum(CASE WHEN dataset = 'ref' THEN n ELSE 0 END) AS BIGINT) AS ref_n, CAST(sum(CASE WHEN dataset = 'tgt' THEN n ELSE 0 END) AS BIGINT) AS tgt_n FROM ({COUNTS}) GROUP BY ALL)"


def long(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("disc", F.nullif("l_discount", F.lit(0.0)))
    return R.long_numbers(li, "l_linestatus", COLS)


def counts(spark, sf):
    d = table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", "ref").otherwise("tgt").alias("dataset"), "source", "lang",
        F.when(F.col("n_chars") < 3000, F.floor(F.col("n_chars") / 500).cast("string")).alias("size"),
    )
    return D.token_counts(d, "dataset", ["source", "lang", "size"])


def aligned(spark, sf):
    return K.align_counts(counts(spark, sf), "dataset", "ref", "tgt")


@query(f"WITH {ALIGNED} SELECT * FROM al")
def k8_align_counts(spark, sf):
    return aligned(spark, sf)


@query(f"""WITH {ALIGNED}, s AS (SELECT *, sum(ref_n) OVER (PARTITION BY field) AS ra, sum(tgt_n) OVER (PARTITION BY field) AS ta FROM al)
    SELECT CASE WHEN tgt_n = 0 THEN 'ref' ELSE 'tgt' END AS side, field, value, CASE WHEN tgt_n = 0 THEN ref_n ELSE tgt_n END AS n, round(CASE WHEN tgt_n = 0 THEN ref_n / ra ELSE tgt_n / ta END, 6) AS share
    FROM s WHERE (ref_n = 0) <> (tgt_n = 0) AND value NOT IN ('__MISSING__', '__EMPTY__')""")
def k9_exclusive_values(spark, sf):
    return rounded(K.exclusive_values(aligned(spark, sf)))


def kind_sql(field: str, value: str, fixed: str = "") -> str:
    kind = f"WHEN count({value}) > 0 THEN '{fixed}'" if fixed else f"WHEN count(try_cast({value} AS DOUBLE)) >= 0.95 * count({value}) THEN 'numeric_scalar' ELSE 'categorical_scalar'"
    return f"SELECT '{field}' AS field, CASE WHEN count({value}) = 0 THEN 'all_missing' {kind} END AS kind FROM orders"


@query(" UNION ALL ".join([
    kind_sql("price", "CAST(o_totalprice AS VARCHAR)"), kind_sql("mixed", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE CAST(o_totalprice AS VARCHAR) END"),
    kind_sql("nothing", "CAST(NULL AS VARCHAR)"), kind_sql("words", "o_orderpriority", "categorical_multilabel"), kind_sql("dict", "'{}'", "mixed_skip"),
]))
def a22_infer_kinds(spark, sf):
    o = table(spark, sf, "orders")
    cell = lambda f, v, is_list=False, is_dict=False: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), F.lit(is_list).alias("is_list"), F.lit(is_dict).alias("is_dict"))
    mixed = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise(F.col("o_totalprice").cast("string"))
    cells = [cell("price", F.col("o_totalprice")), cell("mixed", mixed), cell("nothing", F.lit(None)), cell("words", F.col("o_orderpriority"), True), cell("dict", F.lit("{}"), False, True)]
    return R.infer_kinds(o.select(F.inline(F.array(*cells))))


@query(f"""SELECT field, dataset, round(1 - count(x) / count(*), 6) AS missing_rate, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min,
    {", ".join(f"round(quantile_cont(x, {v}), 6) AS {k}" for k, v in R.QUANTILES.items())}, max(x) AS max FROM ({LONG}) GROUP BY ALL""")
def a23_two_sample_summary(spark, sf):
    """A field that one side alone has is left out."""
    one_sided = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(F.lit("F").alias("dataset"), F.lit("one_sided").alias("field"), F.col("l_tax").cast("double").alias("x"))
    return rounded(R.two_sample_summary(long(spark, sf).unionByName(one_sided)))


def psi_sql() -> str:
    at = ", ".join(str(i / 10) for i in range(11))
    return f"""l AS (SELECT * FROM ({LONG}) WHERE x IS NOT NULL), w AS (SELECT field, quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM l WHERE dataset = 'F' GROUP BY field),
    c AS (SELECT dataset, field, least(greatest(x, CASE WHEN a = b THEN a - 0.5 ELSE a END), CASE WHEN a = b THEN b + 0.5 ELSE b END) AS x FROM l JOIN w USING (field)),
    e AS (SELECT field, list_sort(list_distinct(quantile_cont(x, [{at}]))) AS e FROM c WHERE dataset = 'F' GROUP BY field),
    b AS (SELECT dataset, field, CAST(len(list_filter(e[2:len(e) - 1], lambda y: y <= x)) AS INT) AS bin FROM c JOIN e USING (field)),
    k AS (SELECT field, CAST(unnest(range(len(e) - 1)) AS INT) AS bin FROM e),
    n AS (SELECT k.field, k.bin, count(*) FILTER (dataset = 'F') AS r, count(*) FILTER (dataset = 'O') AS t FROM k LEFT JOIN b ON b.field = k.field AND b.bin = k.bin GROUP BY ALL),
    s AS (SELECT field, bin, greatest(r / sum(r) OVER (PARTITION BY field), 1e-6) AS p, greatest(t / sum(t) OVER (PARTITION BY field), 1e-6) AS q FROM n)"""


@query(f"WITH {psi_sql()} SELECT field, bin, round(p, 6) AS ref_share, round(q, 6) AS tgt_share, round((p - q) * ln(p / q), 6) AS term FROM s")
def a24_psi_bins(spark, sf):
    return rounded(R.psi_bins(long(spark, sf), "F", "O"))


@query(f"WITH {psi_sql()} SELECT field, round(sum((p - q) * ln(p / q)), 6) AS psi FROM s GROUP BY field")
def a24_psi_numeric(spark, sf):
    return rounded(R.psi_numeric(long(spark, sf), "F", "O"))


CATEGORICAL = f"""{ALIGNED}, sh AS (SELECT field, greatest(ref_n / sum(ref_n) OVER (PARTITION BY field), 1e-6) AS p, greatest(tgt_n / sum(tgt_n) OVER (PARTITION BY field), 1e-6) AS q FROM al)"""


@query(f"WITH {CATEGORICAL} SELECT field, round(sum((p - q) * ln(p / q)), 6) AS psi FROM sh GROUP BY field")
def a25_psi_categorical(spark, sf):
    return rounded(R.psi_categorical(aligned(spark, sf)))


CUMULATIVE = f"""n AS (SELECT field, x, count(*) FILTER (dataset = 'F') AS r, count(*) FILTER (dataset = 'O') AS t FROM ({LONG}) WHERE x IS NOT NULL GROUP BY ALL),
    f AS (SELECT field, x, sum(r) OVER w / sum(r) OVER (PARTITION BY field) AS fr, sum(t) OVER w / sum(t) OVER (PARTITION BY field) AS ft, lead(x) OVER w - x AS step FROM n WINDOW w AS (PARTITION BY field ORDER BY x))"""


@query(f"WITH {CUMULATIVE} SELECT field, round(max(abs(fr - ft)), 6) AS ks FROM f GROUP BY field")
def a26_ks(spark, sf):
    return rounded(R.ks_2samp(long(spark, sf), "F", "O"))


@query(f"WITH {CUMULATIVE} SELECT field, round(sum(abs(fr - ft) * step), 5) AS wasserstein FROM f GROUP BY field")
def a27_wasserstein(spark, sf):
    return rounded(R.wasserstein(long(spark, sf), "F", "O"), 5)


@query(f"""WITH {psi_sql()}, {CATEGORICAL}, u AS (SELECT field, 'numeric' AS kind, sum((p - q) * ln(p / q)) AS psi FROM s GROUP BY field UNION ALL SELECT field, 'categorical', sum((p - q) * ln(p / q)) FROM sh GROUP BY field)
    SELECT field, kind, round(psi, 6) AS psi, CAST(row_number() OVER (ORDER BY round(psi, 9) DESC, field) AS INT) AS rank FROM u""")
def a28_shift_rank(spark, sf):
    return rounded(R.shift_rank(R.psi_numeric(long(spark, sf), "F", "O"), R.psi_categorical(aligned(spark, sf))))


@query(f"SELECT dataset, field, value, n, round(n / sum(n) OVER (PARTITION BY dataset, field), 6) AS share FROM ({COUNTS})")
def a29_enum_shares(spark, sf):
    return rounded(R.enum_shares(counts(spark, sf)))


@query(f"""WITH {ALIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY ref_n + tgt_n DESC, value) AS k FROM al),
    s AS (SELECT *, k <= 5 OR ref_n = 0 OR tgt_n = 0 AS shown FROM r), c AS (SELECT *, shown AND row_number() OVER (PARTITION BY field, shown ORDER BY k) <= 60 AS keep FROM s)
    SELECT field, CASE WHEN keep THEN value ELSE 'OTHER' END AS value, CAST(sum(ref_n) AS BIGINT) AS ref_n, CAST(sum(tgt_n) AS BIGINT) AS tgt_n FROM c GROUP BY 1, 2""")
def a30_lump_other(spark, sf):
    return R.lump_other(aligned(spark, sf), 5)


@query(f"""WITH h AS (SELECT dataset, field, CAST(least(CASE WHEN x >= 50 THEN 5 WHEN x >= 20 THEN 4 WHEN x >= 10 THEN 3 WHEN x >= 5 THEN 2 WHEN x >= 1 THEN 1 ELSE 0 END, 4) AS INT) AS bin FROM ({LONG}) WHERE x BETWEEN 0 AND 50),
    k AS (SELECT DISTINCT dataset, field, CAST(b AS INT) AS bin FROM ({LONG}), range(5) t(b)), g AS (SELECT k.dataset, k.field, k.bin, count(h.bin) AS n FROM k LEFT JOIN h ON h.dataset = k.dataset AND h.field = k.field AND h.bin = k.bin GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY dataset, field) / [1, 4, 5, 10, 30][bin + 1], 6) AS density FROM g""")
def a31_histogram(spark, sf):
    return rounded(R.histogram(long(spark, sf), [0, 1, 5, 10, 20, 50]))


@query(f"""WITH g AS (SELECT dataset, field, x, count(*) AS n FROM ({LONG}) WHERE x IS NOT NULL GROUP BY ALL)
    SELECT dataset, field, x, round(sum(n) OVER (PARTITION BY dataset, field ORDER BY x) / sum(n) OVER (PARTITION BY dataset, field), 6) AS share FROM g""")
def a31_ecdf(spark, sf):
    return rounded(R.ecdf(long(spark, sf)))
