"""Documents of unknown shape, made from events: fields that only some have, lists, nested objects, nulls, and one of mixed types."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import documents as D
from cairn.operators import drift as R
from cairn.plans.base import query, rounded, table

#: An event as JSON, in SQL that both engines read.
JSON = """concat('{"id":', event_id, ',"props":', props, ',"type":"', event_type, '","stats":{"v":', CAST(floor(value) AS BIGINT), ',"tags":["', event_type, '","u', user_id % 3, '"]',
    CASE WHEN event_id % 2 = 0 THEN ',"extra":{"none":null,"flag":true}' ELSE '' END, CASE WHEN event_id % 7 = 0 THEN ',"list":[]' ELSE ',"list":[{"a":1},2]' END, '}',
    CASE event_id % 5 WHEN 0 THEN ',"mixed":"abc"' WHEN 1 THEN ',"mixed":{"in":1}' ELSE ',"mixed":7' END,
    ',"code":', CASE WHEN event_id % 30 = 0 THEN '"none"' WHEN event_id % 3 = 0 THEN '"12"' ELSE '12' END, CASE WHEN event_id % 11 = 0 THEN ',"broken":}' ELSE '}' END)"""

LEAVES = f"""d AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'ref' ELSE 'tgt' END AS dataset, {JSON} AS text FROM events),
    l AS (SELECT event_id, dataset, substr(fullkey, 3) AS field, type, value, json_extract_string(value, '$') AS s FROM (SELECT * FROM d WHERE json_valid(text)) t, json_tree(t.text)
        WHERE fullkey NOT LIKE '%[%' AND fullkey <> '$' AND coalesce(type, '') <> 'OBJECT'),
    f AS (SELECT event_id, dataset, field, CASE WHEN type = 'ARRAY' THEN 'list' WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'num' WHEN type IN ('VARCHAR', 'BOOLEAN') THEN 'cat' END AS kind,
        CASE WHEN type = 'BOOLEAN' THEN CASE WHEN s = 'true' THEN 1.0 ELSE 0.0 END WHEN type <> 'ARRAY' THEN try_cast(s AS DOUBLE) END AS num_value,
        CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR', 'BOOLEAN') THEN s END AS cat_value, CASE WHEN type = 'ARRAY' THEN CAST(value AS VARCHAR[]) END AS list_value FROM l),
    h AS (SELECT field, count(*) AS n, count(kind) AS known, count(num_value) AS numbers, bool_or(coalesce(kind, '') = 'list') AS lists FROM f GROUP BY field),
    k AS (SELECT field, CASE WHEN lists THEN 'categorical_multilabel' WHEN EXISTS (SELECT 1 FROM h o WHERE starts_with(o.field, h.field || '.')) THEN 'mixed_skip' WHEN known = 0 THEN 'all_missing'
        WHEN numbers >= 0.95 * known THEN 'numeric_scalar' ELSE 'categorical_scalar' END AS kind, n, known FROM h)"""


def documents(spark, sf):
    text = F.expr(JSON)
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "ref").otherwise("tgt").alias("dataset"), text.alias("text"))
    return D.parse_documents(rows, "text")


def flat(spark, sf):
    return D.flatten_documents(documents(spark, sf)[0], keep=["event_id", "dataset"])


@query(f"WITH {LEAVES} SELECT * FROM f")
def p7_flatten_documents(spark, sf):
    return flat(spark, sf)


@query(f"WITH {LEAVES} SELECT event_id, dataset, text FROM d WHERE NOT json_valid(text)")
def s1_broken_documents(spark, sf):
    return documents(spark, sf)[1]


@query(f"WITH {LEAVES} SELECT * FROM k")
def a22_document_kinds(spark, sf):
    return D.document_kinds(flat(spark, sf))


def totals(spark, sf):
    return {r.dataset: r["count"] for r in documents(spark, sf)[0].groupBy("dataset").count().collect()}  # a row for each dataset


@query(f"""WITH {LEAVES}, g AS (SELECT dataset, count(*) AS total FROM d WHERE json_valid(text) GROUP BY dataset),
    v AS (SELECT dataset, f.field, unnest(CASE WHEN f.kind = 'list' THEN CASE WHEN len(list_value) = 0 THEN ['__EMPTY__'] ELSE list_distinct(list_value) END ELSE [cat_value] END) AS value
        FROM f JOIN k USING (field) WHERE k.kind LIKE 'categorical%' AND f.kind IS NOT NULL),
    m AS (SELECT g.dataset, k.field, '__MISSING__' AS value, total - (SELECT count(*) FROM f WHERE f.field = k.field AND f.dataset = g.dataset AND f.kind IS NOT NULL) AS n FROM g, k WHERE k.kind LIKE 'categorical%')
    SELECT dataset, field, value, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT * FROM m WHERE n > 0""")
def a6_document_counts(spark, sf):
    rows = flat(spark, sf)
    return D.document_counts(rows, D.document_kinds(rows), totals(spark, sf))


@query(f"""WITH {LEAVES}, g AS (SELECT dataset, count(*) AS total FROM d WHERE json_valid(text) GROUP BY dataset)
    SELECT field, dataset, round(1 - count(num_value) / any_value(total), 6) AS missing_rate, count(num_value) AS n, round(avg(num_value), 6) AS mean, round(stddev_pop(num_value), 6) AS std,
    min(num_value) AS min, {", ".join(f"round(quantile_cont(num_value, {v}), 6) AS {k}" for k, v in R.QUANTILES.items())}, max(num_value) AS max
    FROM f JOIN k USING (field) JOIN g USING (dataset) WHERE k.kind = 'numeric_scalar' GROUP BY field, dataset
    QUALIFY min(count(num_value)) OVER (PARTITION BY field) >= 50 AND count(*) OVER (PARTITION BY field) = 2""")
def a23_document_summary(spark, sf):
    rows = flat(spark, sf)
    return rounded(R.two_sample_summary(D.document_numbers(rows, D.document_kinds(rows)), totals=totals(spark, sf)))
