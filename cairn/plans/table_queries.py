"""Statistics, association, co-occurrence, metrics and slices on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.stats import chi2_p_value
from cairn.operators import association as A
from cairn.operators import cooccur as C
from cairn.operators import describe as D
from cairn.operators import metrics as M
from cairn.operators import slices as S
from cairn.plans.base import query, rounded, shared_path, table
from cairn.plans.scalar_queries import PREDICTIONS, predictions

NUM = ["l_quantity", "l_extendedprice", "disc", "l_tax"]
LINES = """(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS disc, l_tax, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(l_linestatus = 'O' AS INT) AS y FROM lineitem)"""
LABELLED = "(SELECT d.doc_id, lang, source, quality, toxic, n_chars FROM documents d JOIN labels USING (doc_id))"
TAGS = "(SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part)"


def lines(spark, sf):
    return table(spark, sf, "lineitem").withColumns({"disc": F.nullif("l_discount", F.lit(0.0)), "y": (F.col("l_linestatus") == "O").cast("int")})


def labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")


def parts(spark, sf):
    return table(spark, sf, "part").withColumn("words", F.split("p_name", " "))


def each(sql: str, fields=NUM, glue: str = " UNION ALL ") -> str:
    """The SQL once for each field, {f} being its name."""
    return glue.join(sql.replace("{f}", f) for f in fields)


@query(each(f"SELECT '{{f}}' AS field, count(*) AS total, count(*) FILTER ({{f}} IS NULL) AS missing, round(count(*) FILTER ({{f}} IS NULL) / count(*), 6) AS missing_rate FROM {LINES}"))
def a1_missing_by_field(spark, sf):
    return rounded(D.missing_by_field(lines(spark, sf).select(*NUM)))


@query("SELECT o_orderkey, f AS field FROM (SELECT o_orderkey, unnest([CASE WHEN o_orderstatus = 'F' THEN 'status' END, CASE WHEN o_custkey % 2 = 0 THEN 'cust' END]) AS f FROM orders) WHERE f IS NOT NULL")
def a1_missing_cells(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", "x").alias("status"), F.when(F.col("o_custkey") % 2 != 0, 1).alias("cust"))
    return D.missing_cells(o, "o_orderkey")


@query(each(f"""SELECT '{{f}}' AS field, count({{f}}) AS count, round(avg({{f}}), 6) AS mean, round(stddev_samp({{f}}), 6) AS std, min({{f}}) AS min, round(quantile_cont({{f}}, 0.25), 6) AS p25,
    round(quantile_cont({{f}}, 0.5), 6) AS p50, round(quantile_cont({{f}}, 0.75), 6) AS p75, max({{f}}) AS max FROM {LINES}"""))
def a2_numeric_summary(spark, sf):
    return rounded(D.numeric_summary(lines(spark, sf), NUM))


@query(each(f"SELECT '{{f}}' AS field, round(avg({{f}}), 6) AS mean, round(stddev_samp({{f}}), 6) AS std, min({{f}}) AS min, max({{f}}) AS max, count({{f}}) AS n FROM {LINES}"))
def a3_variance_summary(spark, sf):
    return rounded(D.variance_summary(lines(spark, sf), NUM))


@query(each("SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM documents GROUP BY {f}", ["lang", "source"]))
def a4_value_counts(spark, sf):
    return D.value_counts(table(spark, sf, "documents"), ["lang", "source"])


@query("SELECT 'status' AS field, CASE WHEN o_orderstatus = 'F' THEN 'None' ELSE o_orderstatus END AS value, count(*) AS n FROM orders GROUP BY ALL")
def a4_value_counts_null_text(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    return D.value_counts(o, ["status"], missing="text")


@query("SELECT 'words' AS field, w AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || p_name, ' ')) AS w FROM part) GROUP BY ALL")
def a5_multilabel_occurrences(spark, sf):
    return D.multilabel_counts(parts(spark, sf).withColumn("words", F.concat("words", "words")), ["words"])


@query(f"SELECT 'words' AS field, tag AS value, count(*) AS n FROM {TAGS} GROUP BY ALL")
def a5_multilabel_entities(spark, sf):
    return D.multilabel_counts(parts(spark, sf).withColumn("words", F.concat("words", "words")), ["words"], per_entity=True)


@query("""SELECT p_type AS dataset, 'brand' AS field, CASE WHEN p_size % 5 = 0 THEN '__MISSING__' ELSE p_brand END AS value, count(*) AS n FROM part GROUP BY ALL
    UNION ALL SELECT p_type, 'words', w, count(*) FROM (SELECT p_type, unnest(CASE p_size % 4 WHEN 0 THEN ['__EMPTY__'] WHEN 1 THEN ['__MISSING__'] ELSE list_distinct(string_split(p_name, ' ')) END) AS w FROM part) GROUP BY ALL""")
def a6_token_counts(spark, sf):
    k = F.col("p_size") % 4
    words = F.when(k == 0, F.array().cast("array<string>")).when(k != 1, F.col("words"))
    p = parts(spark, sf).select(F.col("p_type").alias("dataset"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("brand"), words.alias("words"))
    return D.token_counts(p, "dataset", ["brand"], ["words"])


@query("""WITH v AS (SELECT DISTINCT 'p_type' AS field, p_type AS token FROM part UNION SELECT DISTINCT 'words', unnest(string_split(p_name, ' ')) FROM part)
    SELECT field, token, CAST(row_number() OVER (PARTITION BY field ORDER BY token) AS INT) AS index_in_block FROM v UNION ALL SELECT 'p_type', 'unknown', 0 UNION ALL SELECT 'words', 'unknown', 0""")
def a7_vocab(spark, sf):
    return D.build_vocab(parts(spark, sf), ["p_type"], ["words"])


@query(each(f"SELECT '{{f}}' AS field, {{f}} AS value, count(*) FILTER (quality = 0) AS label0, count(*) FILTER (quality = 1) AS label1 FROM {LABELLED} GROUP BY {{f}}", ["lang", "source"]))
def a8_contingency(spark, sf):
    return A.contingency(labelled(spark, sf), "quality", ["lang", "source"])


@query("""SELECT 'words' AS field, w AS value, count(*) FILTER (y = 0) AS label0, count(*) FILTER (y = 1) AS label1
    FROM (SELECT unnest(string_split(p_name, ' ')) AS w, CAST(p_size > 25 AS INT) AS y FROM part) GROUP BY ALL""")
def a8_contingency_multilabel(spark, sf):
    return A.contingency(parts(spark, sf).withColumn("y", (F.col("p_size") > 25).cast("int")), "y", [], ["words"])


CHI2 = f"""WITH t AS ({each(f"SELECT '{{f}}' AS field, CAST({{f}} AS VARCHAR) AS value, count(*) FILTER (quality = 0) AS a, count(*) FILTER (quality = 1) AS b FROM {LABELLED} GROUP BY {{f}}", ["lang", "source", "toxic"])}),
    m AS (SELECT *, sum(a) OVER (PARTITION BY field) AS n0, sum(b) OVER (PARTITION BY field) AS n1, count(*) OVER (PARTITION BY field) AS k FROM t),
    e AS (SELECT *, (a + b) * n0 / (n0 + n1) AS ea, (a + b) * n1 / (n0 + n1) AS eb FROM m),
    g AS (SELECT *, CASE WHEN k = 2 THEN greatest(abs(a - ea) - 0.5, 0) ELSE abs(a - ea) END AS ga, CASE WHEN k = 2 THEN greatest(abs(b - eb) - 0.5, 0) ELSE abs(b - eb) END AS gb FROM e)
    SELECT field, round(sum(ga * ga / ea + gb * gb / eb), 6) AS chi2, CAST(max(k) - 1 AS INT) AS dof, CAST(max(k) AS INT) AS n_categories FROM g GROUP BY field HAVING max(k) >= 2"""


@query(CHI2)
def a9_chi_square(spark, sf):
    """Documents with labels -> contingency -> chi-square."""
    return rounded(A.chi_square(A.contingency(labelled(spark, sf), "quality", ["lang", "source", "toxic"])))


#: The tail is 1 less the series of the lower incomplete gamma function.
SERIES = "1 - list_sum(list_transform(range(0, 3000), lambda i: exp((dof / 2 + i) * ln(greatest(chi2, 1e-300) / 2) - chi2 / 2 - lgamma(dof / 2 + i + 1))))"


@query(f"SELECT field, chi2, dof, n_categories, round({SERIES}, 6) + 0 AS p_value FROM ({CHI2})")
def a9_chi_square_p(spark, sf):
    return rounded(rounded(A.chi_square(A.contingency(labelled(spark, sf), "quality", ["lang", "source", "toxic"]))).withColumn("p_value", chi2_p_value("chi2", "dof")))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL),
    f AS (SELECT x.a, y.b, coalesce(c.n, 0) AS o, na * nb / t.n AS e, t.n AS n FROM (SELECT a, sum(n) AS na FROM c GROUP BY a) x CROSS JOIN (SELECT b, sum(n) AS nb FROM c GROUP BY b) y
    CROSS JOIN (SELECT sum(n) AS n FROM c) t LEFT JOIN c ON c.a = x.a AND c.b = y.b)
    SELECT round(sqrt(sum((o - e) * (o - e) / e) / (max(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS v, round(sum((o - e) * (o - e) / e), 5) AS chi2, CAST(max(n) AS BIGINT) AS n,
    count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM f""")
def a10_cramers_v(spark, sf):
    out = A.cramers_v(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(out.withColumn("chi2", F.round("chi2", 5)))


@query(each(f"SELECT '{{f}}' AS field, round(corr({{f}}, y), 6) AS r, count({{f}}) AS n FROM {LINES}"))
def a11_point_biserial(spark, sf):
    return rounded(A.point_biserial(lines(spark, sf), NUM, "y"))


@query(each(f"""SELECT '{{f}}' AS field, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx,
    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT {{f}} AS x, y FROM {LINES} WHERE {{f}} IS NOT NULL))"""))
def a12_spearman(spark, sf):
    return rounded(A.spearman(lines(spark, sf), NUM, "y"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {LINES}" for i, a in enumerate(NUM) for b in NUM[i + 1 :]))
def a13_pearson(spark, sf):
    return rounded(A.pearson_matrix(lines(spark, sf), NUM))


FEATURES = """(SELECT DISTINCT p_partkey, 'words=' || unnest(string_split(p_name, ' ')) AS feature FROM part UNION SELECT p_partkey, 'p_type=' || p_type FROM part)"""


def design(spark, sf):
    return A.binary_features(parts(spark, sf), "p_partkey", ["p_type"], ["words"])


@query(f"SELECT p_partkey, feature FROM {FEATURES}")
def a14_binary_features(spark, sf):
    return design(spark, sf)


def phi_sql(k: int, limit: str = "") -> str:
    return f"""WITH f AS (SELECT * FROM {FEATURES}), n AS (SELECT count(*) AS n FROM part), m AS (SELECT feature, count(*) AS m FROM f GROUP BY feature {limit}),
    g AS (SELECT x.feature AS a, y.feature AS b, CAST(x.m AS DOUBLE) AS na, CAST(y.m AS DOUBLE) AS nb FROM m x JOIN m y ON x.feature < y.feature),
    c AS (SELECT x.feature AS a, y.feature AS b, count(*) AS nab FROM f x JOIN f y ON x.p_partkey = y.p_partkey AND x.feature < y.feature GROUP BY ALL),
    p AS (SELECT g.a, g.b, (n * coalesce(nab, 0) - na * nb) / sqrt(na * (n - na) * nb * (n - nb)) AS phi FROM g LEFT JOIN c ON c.a = g.a AND c.b = g.b CROSS JOIN n)
    SELECT a, b, round(phi, 6) AS phi, round(abs(phi), 6) AS abs_r FROM p ORDER BY round(abs(phi), 9) DESC, a, b LIMIT {k}"""


@query(phi_sql(100))
def a15_binary_pairs(spark, sf):
    return rounded(A.binary_pair_corr(design(spark, sf), "p_partkey", table(spark, sf, "part").count(), 100))


@query(phi_sql(100, "ORDER BY (m / (SELECT n FROM n)) * (1 - m / (SELECT n FROM n)) DESC, feature LIMIT 10"))
def a15_top_std_pairs(spark, sf):
    return rounded(A.top_std_corr(design(spark, sf), "p_partkey", table(spark, sf, "part").count(), 10))


@query(f"""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r,
    CAST(count(*) AS BIGINT) AS n FROM {LINES}""")
def a16_linear_fit(spark, sf):
    return rounded(rounded(A.linear_fit(lines(spark, sf), "l_quantity", "l_extendedprice"), 4, ["slope", "intercept"]))


@query(f"""WITH x AS (SELECT l_returnflag AS category, l_extendedprice AS v FROM {LINES} WHERE l_returnflag IN ('R', 'A')), q AS (SELECT category, count(*) AS n, quantile_cont(v, 0.25) AS q1,
    quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY category),
    w AS (SELECT category, min(v) AS lo, max(v) AS hi FROM x JOIN q USING (category) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY category)
    SELECT category, CAST(CASE category WHEN 'R' THEN 1 ELSE 2 END AS INT) AS position, n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, lo AS whisker_low, hi AS whisker_high FROM q JOIN w USING (category)""")
def a17_box_stats(spark, sf):
    return rounded(D.box_stats(lines(spark, sf), "l_returnflag", "l_extendedprice", ["R", "A"]))


FAMILIES = {"colour": ["red", "blue"], "state": ["hot", "cold", "old", "new", "small", "large"], "thing": ["widget", "plate", "gear", "bolt", "rod", "ring", "gizmo", "anvil"]}
FAMILY = "CASE WHEN tag IN ('red', 'blue') THEN 'colour' WHEN tag IN ('hot', 'cold', 'old', 'new', 'small', 'large') THEN 'state' ELSE 'thing' END"


def tags(spark, sf):
    return C.tag_rows(parts(spark, sf), "p_partkey", "words")


@query(f"SELECT family, tag, n, CAST(row_number() OVER (PARTITION BY family ORDER BY n DESC, tag) AS INT) AS rank FROM (SELECT {FAMILY} AS family, tag, count(*) AS n FROM {TAGS} GROUP BY ALL)")
def a18_tag_families(spark, sf):
    return C.tag_families(C.with_family(tags(spark, sf), FAMILIES))


@query(f"""WITH f AS (SELECT DISTINCT p_partkey, {FAMILY} AS family FROM {TAGS}) SELECT x.family AS a, y.family AS b, count(*) AS n FROM f x JOIN f y USING (p_partkey) WHERE x.family <= y.family GROUP BY ALL""")
def a19_family_cooccurrence(spark, sf):
    return C.family_cooccurrence(C.with_family(tags(spark, sf), FAMILIES), "p_partkey")


PAIRS = f"""p AS (SELECT tag, count(*) AS p FROM t GROUP BY tag), s AS (SELECT x.tag AS a, y.tag AS b, count(*) AS co FROM t x JOIN t y USING (p_partkey) WHERE x.tag <= y.tag GROUP BY ALL),
    r AS (SELECT a, b, co, x.p AS pa, y.p AS pb FROM s JOIN p x ON x.tag = a JOIN p y ON y.tag = b)"""


@query(f"WITH t AS (SELECT * FROM {TAGS} WHERE {FAMILY} = 'thing'), {PAIRS} SELECT * FROM r")
def a20_pair_stats_family(spark, sf):
    return C.pair_stats(C.with_family(tags(spark, sf), FAMILIES), "p_partkey", family="thing")


@query(f"WITH u AS (SELECT * FROM {TAGS}), t AS (SELECT * FROM u WHERE tag IN (SELECT tag FROM u GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 6)), {PAIRS} SELECT * FROM r")
def a20_pair_stats_top(spark, sf):
    return C.pair_stats(tags(spark, sf), "p_partkey", top_k=6)


@query(f"WITH t AS (SELECT * FROM {TAGS}), {PAIRS} SELECT a, b, co, pa, pb, round(co / (pa + pb - co), 6) AS value FROM r")
def a21_jaccard(spark, sf):
    return rounded(C.pair_metric(C.pair_stats(tags(spark, sf), "p_partkey", top_k=40), "jaccard"))


@query(f"WITH t AS (SELECT * FROM {TAGS}), {PAIRS} SELECT a, b, co, pa, pb, round(ln(co * (SELECT greatest(max(pa), max(pb), max(co)) FROM r) / (pa * pb)), 6) AS value FROM r")
def a21_pmi(spark, sf):
    return rounded(C.pair_metric(C.pair_stats(tags(spark, sf), "p_partkey", top_k=40), "pmi"))


@query(f"WITH t AS (SELECT * FROM {TAGS}), {PAIRS} SELECT a, b, co, pa, pb, CAST(co AS DOUBLE) AS value FROM r")
def a21_count(spark, sf):
    return C.pair_metric(C.pair_stats(tags(spark, sf), "p_partkey", top_k=40), "count")


CELLS = f"""c AS (SELECT model, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn
    FROM (SELECT 'pred_base' AS model, label, pred_base AS pred FROM {PREDICTIONS} UNION ALL SELECT 'pred_new', label, pred_new FROM {PREDICTIONS}) GROUP BY model)"""
REPORT = f"""{CELLS}, p AS (SELECT model, 0 AS class, tn AS hit, fn AS wrong, fp AS miss FROM c UNION ALL SELECT model, 1, tp, fp, fn FROM c),
    r AS (SELECT model, class, coalesce(hit / nullif(hit + wrong, 0), 0) AS precision, coalesce(hit / nullif(hit + miss, 0), 0) AS recall, coalesce(2 * hit / nullif(2 * hit + wrong + miss, 0), 0) AS f1, hit + miss AS support FROM p)"""


def both_models(spark, sf):
    return M.long_predictions(predictions(spark, sf), ["pred_base", "pred_new"])


@query(f"""WITH {CELLS} SELECT model, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS auc, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round((tp + tn) / (tp + tn + fp + fn), 6) AS acc FROM c""")
def a32_binary_metrics(spark, sf):
    return rounded(M.binary_metrics(both_models(spark, sf)))


@query(f"WITH {REPORT} SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r")
def a33_class_report(spark, sf):
    return rounded(M.class_report(both_models(spark, sf)))


@query(f"""WITH {REPORT} SELECT model, round((max(tp) / max(tp + fn) + max(tn) / max(tn + fp)) / 2, 4) AS auc, round(avg(f1), 4) AS f1, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision,
    round(max(tp + tn) / max(tp + tn + fp + fn), 4) AS acc FROM r JOIN c USING (model) GROUP BY model""")
def a33_macro_metrics(spark, sf):
    return M.macro_metrics(both_models(spark, sf))


@query(f"""WITH u AS (SELECT 'pred_base' AS model, label, pred_base AS pred FROM {PREDICTIONS} UNION ALL SELECT 'pred_new', label, pred_new FROM {PREDICTIONS}), g AS (SELECT model, label, pred, count(*) AS n FROM u GROUP BY ALL)
    SELECT model, label, pred, n, CASE WHEN label = pred THEN CASE label WHEN 1 THEN 'TP' ELSE 'TN' END ELSE CASE pred WHEN 1 THEN 'FP' ELSE 'FN' END END AS cell_type,
    round(n / sum(n) OVER (PARTITION BY model), 6) AS proportion FROM g""")
def a34_confusion(spark, sf):
    return rounded(M.confusion(both_models(spark, sf)))


ERRORS = f"(SELECT *, CAST(pred_base <> label AS INT) AS eb, CAST(pred_new <> label AS INT) AS en FROM {PREDICTIONS})"
RATES = "count(*) AS support, round(avg(eb), 6) AS base_error_rate, round(avg(en), 6) AS new_error_rate, round(avg(en) - avg(eb), 6) AS delta_error"


def errors(spark, sf):
    return S.with_errors(predictions(spark, sf), "label", "pred_base", "pred_new")


@query(f"SELECT CAST(label AS VARCHAR) || '×' || lang AS slice, {RATES} FROM {ERRORS} GROUP BY 1")
def a35_slice_error(spark, sf):
    return rounded(S.slice_error(errors(spark, sf), F.concat(F.col("label").cast("string"), F.lit("×"), F.col("lang"))))


def bins_sql(q: int) -> str:
    """right-closed quantile bins over unique edges"""
    at = ", ".join(str(i / q) for i in range(q + 1))
    return f"e AS (SELECT list_sort(list_distinct(quantile_cont(n_chars, [{at}]))) AS e FROM {PREDICTIONS})"


BIN = "CAST(greatest(0, least(len(list_filter(e, lambda x: x < n_chars)) - 1, len(e) - 2)) AS INT)"


@query(f"WITH {bins_sql(4)} SELECT {BIN} AS bin, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM {PREDICTIONS} CROSS JOIN e GROUP BY 1")
def a36_qcut(spark, sf):
    return S.qcut(predictions(spark, sf), "n_chars", 4).groupBy("bin").agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query(f"WITH {bins_sql(3)} SELECT ['low', 'mid', 'high'][{BIN} + 1] AS slice, {RATES} FROM {ERRORS} CROSS JOIN e GROUP BY 1")
def a36_qcut_labels(spark, sf):
    return rounded(S.slice_error(S.qcut(errors(spark, sf), "n_chars", 3, ["low", "mid", "high"]), "bin"))


@query(f"""WITH m AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM {PREDICTIONS}), g AS (SELECT CAST(greatest(0, least(7, ceil((n_chars - lo) / (hi - lo) * 8) - 1)) AS INT) AS b, eb, en FROM {ERRORS} CROSS JOIN m),
    t AS (SELECT CAST(b AS VARCHAR) AS slice, {RATES} FROM g GROUP BY 1)
    SELECT s.slice, coalesce(support, 0) AS support, base_error_rate, new_error_rate, delta_error FROM (SELECT CAST(unnest(range(8)) AS VARCHAR) AS slice) s LEFT JOIN t USING (slice)""")
def a37_cut(spark, sf):
    return rounded(S.all_bins(S.slice_error(S.cut(errors(spark, sf), "n_chars", 8), "bin"), [str(i) for i in range(8)]))


SLICES = f"""{bins_sql(4)}, s AS (SELECT 'lang' AS feature, lang AS slice_value, eb, en FROM {ERRORS} UNION ALL SELECT 'source', source, eb, en FROM {ERRORS}
    UNION ALL SELECT 'n_chars', CAST({BIN} AS VARCHAR), eb, en FROM {ERRORS} CROSS JOIN e), t AS (SELECT feature, slice_value, {RATES} FROM s GROUP BY 1, 2)"""


def all_slices(spark, sf):
    return S.slice_all_features(errors(spark, sf), ["lang", "source"], ["n_chars"])


@query(f"WITH {SLICES} SELECT * FROM t")
def a38_slice_all_features(spark, sf):
    return rounded(all_slices(spark, sf))


@query(f"WITH {SLICES} SELECT * FROM t WHERE support >= 20 AND delta_error < 0 ORDER BY delta_error, feature, slice_value LIMIT 10")
def a39_improved(spark, sf):
    return rounded(S.rank_slices(rounded(all_slices(spark, sf)))[0])


@query(f"WITH {SLICES} SELECT * FROM t WHERE support >= 20 AND delta_error > 0 ORDER BY delta_error DESC, feature, slice_value LIMIT 10")
def a39_regressed(spark, sf):
    return rounded(S.rank_slices(rounded(all_slices(spark, sf)))[1])


@query(f"WITH {SLICES} SELECT * FROM t WHERE support >= 50 ORDER BY abs(delta_error), feature, slice_value LIMIT 1")
def a39_least_changed(spark, sf):
    return rounded(S.least_changed(rounded(all_slices(spark, sf))))


@query("""WITH r AS (SELECT o_orderpriority AS dataset, CASE o_orderstatus WHEN 'F' THEN 'M1' WHEN 'O' THEN 'M2' ELSE 'M3' END AS model, o_totalprice / 1e6 AS x FROM orders),
    g AS (SELECT dataset, model, avg(x) AS m, stddev_pop(x) AS s FROM r GROUP BY ALL)
    SELECT dataset, model, printf('%.4f', m) || '±' || printf('%.4f', s) AS acc, CASE WHEN model = 'M2' THEN printf('%+.4f', m - max(CASE WHEN model = 'M1' THEN m END) OVER (PARTITION BY dataset)) ELSE '' END AS acc_delta FROM g""")
def a40_run_summary(spark, sf):
    model = F.when(F.col("o_orderstatus") == "F", "M1").when(F.col("o_orderstatus") == "O", "M2").otherwise("M3")
    runs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), model.alias("model"), (F.col("o_totalprice") / 1e6).alias("acc"))
    return M.run_summary(runs, ["acc"])


@query("""SELECT 'documents_total' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'documents_ok', count(*) FILTER (o_orderstatus <> 'F') FROM orders
    UNION ALL SELECT 'documents_bad', count(*) FILTER (o_orderstatus = 'F') FROM orders
    UNION ALL SELECT 'missing_rate.price', round(count(*) FILTER (o_custkey % 4 = 0) / count(*), 6) FROM orders WHERE o_orderstatus <> 'F'""")
def a49_ingest_summary(spark, sf):
    o = table(spark, sf, "orders").withColumn("price", F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")))
    return rounded(D.ingest_summary(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus = 'F'"), ["price"]))


@query("""SELECT 'documents_total' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'documents_ok', count(*) FILTER (o_orderstatus <> 'F') FROM orders
    UNION ALL SELECT 'documents_bad', count(*) FILTER (o_orderstatus = 'F') FROM orders
    UNION ALL SELECT 'missing_rate.price', round(count(*) FILTER (o_custkey % 4 = 0) / count(*), 6) FROM orders WHERE o_orderstatus <> 'F'""")
def a49_ingest(spark, sf):
    """The same while the good rows are written."""
    o = table(spark, sf, "orders").withColumn("price", F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")))
    return rounded(D.ingest(o, F.col("o_orderstatus") != "F", ["price"], shared_path(spark, "ingest")))



@query("""SELECT o_orderkey, field, x, round(z, 6) AS z, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round(abs(z), 9) DESC, o_orderkey) AS r FROM (
    SELECT o_orderkey, 'o_totalprice' AS field, o_totalprice AS x, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z FROM orders
    UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey, (o_custkey - avg(o_custkey) OVER ()) / stddev_samp(o_custkey) OVER () FROM orders)) WHERE r <= 50""")
def t1_top_outliers(spark, sf):
    return rounded(D.top_outliers(table(spark, sf, "orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"]))
