"""Telemetry, features and segments on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as P
from cairn.operators import describe as D
from cairn.operators import features as X
from cairn.operators import segments as V
from cairn.operators import telemetry as L
from cairn.plans.base import query, rounded, shared_path, table
from cairn.sources import annotations as IO

TURN = "conv_id AS run, turn"


def log(spark, sf):
    """Conversations as training logs: a user's turn opens an epoch and its training, an assistant's turn ends with a bar and metrics.
    Text may follow an epoch's numbers."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    bar = lambda s: F.format_string("100%%|###| 20/20 [%d:%02d<00:00]", F.floor(s / 60), s % 60)
    tail = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, ": lr=1e-4 (7/8)").otherwise(" 2/3 done")
    user = F.array(F.concat(F.format_string("Epoch %d/30", F.col("turn")), tail), F.lit("TRAIN"), bar(F.col("n")), bar(F.col("n") + 1))
    reply = F.array(F.lit("VAL"), bar(F.col("n") + 2), F.format_string("{'auc': 0.5, 'F1': %.4f}", F.col("n") % 97 / 100))
    start = F.array(F.format_string("Namespace(dataset='d%d', lr=0.1)", F.col("conv_id") % 2), F.lit("data load time: 11.02"), F.lit("Testing complete in 1m 55s"))
    rows = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", reply).otherwise(start)
    return c.select(F.col("conv_id").alias("run"), F.posexplode(rows).alias("i", "line"), "turn").select("run", (F.col("turn") * 10 + F.col("i")).alias("line_no"), "line")


#: Turns with the user's turn that came last before or at each: it names the epoch.
EPOCHS = """c AS (SELECT conv_id AS run, turn, role, length(text) AS n, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS epoch FROM conversations)"""


@query(f"""WITH {EPOCHS} SELECT run, CAST(epoch AS INT) AS epoch, CAST(max(CASE WHEN role = 'user' THEN n END) AS INT) AS train_sec, CAST(max_by(CASE WHEN role = 'assistant' THEN n + 2 END, CASE WHEN role = 'assistant' THEN turn END) AS INT) AS val_sec
    FROM c WHERE epoch IS NOT NULL GROUP BY run, epoch""")
def s7_training_log(spark, sf):
    return L.parse_training_log(log(spark, sf))["epochs"].select("run", "epoch", "train_sec", "val_sec")


@query("""WITH s AS (SELECT conv_id, turn, role, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
    SELECT conv_id AS file, turn AS row_no, 'D' || CAST(conv_id % 3 AS VARCHAR) AS dataset, role AS model, CAST(turn AS DOUBLE) AS acc FROM s WHERE role IN ('user', 'assistant') AND conv_id % 3 < 2""")
def s4_result_sheet(spark, sf):
    c = table(spark, sf, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    name = F.when(F.col("turn") == F.col("first"), F.concat(F.lit("D"), (F.col("conv_id") % 3).cast("string"))).otherwise("")
    rows = c.join(first, "conv_id").select(
        F.col("conv_id").alias("file"), F.col("turn").alias("row_no"), name.alias("dataset"), F.col("role").alias("model"), F.format_string("{'Acc': %d}", F.col("turn")).alias("text")
    )
    return L.read_result_sheet(rows, ["D0", "D1"], ["user", "assistant"]).select("file", "row_no", "dataset", "model", F.col("metrics")["acc"].alias("acc"))


def gpu(spark, sf):
    e = table(spark, sf, "events")
    return L.read_gpu_samples(e.select(
        F.col("user_id").alias("run"), F.concat((F.col("event_id") % 5000 + 1).cast("string"), F.lit(" MiB")).alias(" Memory.Used [MiB]"),
        F.lit("81920 MiB").alias("memory.total [MiB]"), F.concat(F.floor("value").cast("string"), F.lit(" %")).alias(" utilization.gpu [%]"),
    ))


@query("SELECT user_id AS run, CAST(event_id % 5000 + 1 AS DOUBLE) AS used_mib, 81920.0::DOUBLE AS total_mib, floor(value) AS util FROM events")
def s5_gpu_samples(spark, sf):
    return gpu(spark, sf).select("run", "used_mib", "total_mib", "util")


def vmstat(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor(F.col("value")).cast("string").alias("v"))
    s = lambda c: c.cast("string")
    rows = F.array(
        F.lit("procs ----memory---"), F.lit(" r  free us sy id wa"), F.concat_ws(" ", F.lit("1"), s(F.col("event_id") * 1024), s(F.col("event_id") % 60), s(F.col("event_id") % 7), "v", F.lit("0")), F.lit("1 2 3"), F.lit("x 1 1 1 1 1")
    )
    lines = e.select(F.col("user_id").alias("run"), "event_id", F.posexplode(rows).alias("i", "line"))
    return L.read_vmstat(lines.select("run", (F.col("event_id") * 10 + F.col("i")).alias("line_no"), "line"))


@query("SELECT user_id AS run, event_id * 10 + 2 AS line_no, event_id % 60 AS us, CAST(floor(value) AS BIGINT) AS id, event_id * 1024 AS free FROM events")
def s6_vmstat(spark, sf):
    c = F.col("cells")
    return vmstat(spark, sf).select("run", "line_no", c["us"].alias("us"), c["id"].alias("id"), c["free"].alias("free"))


@query("""SELECT user_id AS run, CAST(max(event_id % 5000 + 1) AS DOUBLE) AS peak_used_mib, 81920.0::DOUBLE AS total_mib, round(max(event_id % 5000 + 1) / 1024, 6) AS peak_gib, round(max(event_id % 5000 + 1) / 81920 * 100, 6) AS peak_pct,
    round(avg(floor(value)), 6) AS util_mean, round(quantile_cont(floor(value), 0.95), 6) AS util_p95 FROM events GROUP BY user_id""")
def a41_gpu_summary(spark, sf):
    return rounded(L.gpu_summary(gpu(spark, sf)))


@query("""SELECT user_id AS run, count(*) AS rows, round(avg(event_id % 60), 6) AS us_mean, round(avg(event_id % 7), 6) AS sy_mean, 0.0::DOUBLE AS wa_mean, round(avg(floor(value)), 6) AS id_mean,
    round(quantile_cont(floor(value), 0.95), 6) AS id_p95, round(avg(event_id / 1024), 10) AS free_gib_mean, round(quantile_cont(event_id / 1024, 0.95), 10) AS free_gib_p95 FROM events GROUP BY user_id""")
def a42_host_summary(spark, sf):
    samples = vmstat(spark, sf).select("run", *[F.col("cells")[c].alias(c) for c in ("us", "sy", "wa", "id", "free")])
    return rounded(rounded(L.host_summary(samples), 10, ["free_gib_mean", "free_gib_p95"]), 6, ["us_mean", "sy_mean", "wa_mean", "id_mean", "id_p95"])


def hms_sql(c: str) -> str:
    c = f"CAST({c} AS BIGINT)"
    return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} >= 3600 THEN printf('%02d:%02d:%02d', {c} // 3600, {c} % 3600 // 60, {c} % 60) ELSE printf('%02d:%02d', {c} // 60, {c} % 60) END"


@query(f"""WITH {EPOCHS}, t AS (SELECT run, CAST(epoch AS VARCHAR) AS epoch, max(CASE WHEN role = 'user' THEN n END) AS tr, max_by(CASE WHEN role = 'assistant' THEN n + 2 END, CASE WHEN role = 'assistant' THEN turn END) AS va, 1 AS k
      FROM c WHERE epoch IS NOT NULL GROUP BY run, epoch), a AS (SELECT run, 'ALL' AS epoch, sum(tr) AS tr, sum(va) AS va, count(*) AS k FROM t GROUP BY run),
    l AS (SELECT run, max_by(n + 1, turn) AS bar FROM c WHERE role = 'user' GROUP BY run)
    SELECT run, epoch, CAST(tr AS BIGINT) AS train_sec, CAST(va AS BIGINT) AS val_sec, CAST(CASE WHEN epoch = 'ALL' THEN bar END AS INT) AS test_sec, CASE WHEN epoch = 'ALL' THEN k END AS n_epochs,
      {hms_sql('tr')} AS train_hms, {hms_sql('va')} AS val_hms
    FROM (SELECT * FROM t UNION ALL SELECT * FROM a) JOIN l USING (run)""")
def a43_epoch_breakdown(spark, sf):
    parsed = L.parse_training_log(log(spark, sf))
    return L.epoch_breakdown(parsed["epochs"], parsed["run"])


@query(f"""WITH {EPOCHS}, m AS (SELECT run, epoch, max_by(n % 97 / 100, turn) AS f1 FROM c WHERE role = 'assistant' GROUP BY run, epoch)
    SELECT run, CAST(arg_max(epoch, f1 * 1e6 - coalesce(epoch, 0)) AS INT) AS best_epoch, round(max(f1), 4) AS best_score, CAST(max(epoch) AS INT) AS stop_epoch FROM m WHERE epoch IS NOT NULL GROUP BY run""")
def a44_best_epoch(spark, sf):
    parsed = L.parse_training_log(log(spark, sf))
    scores = parsed["metrics"].filter("phase = 'VAL' AND epoch IS NOT NULL").select("run", "epoch", F.col("metrics")["f1"].alias("f1"))
    return rounded(L.best_epoch(scores, parsed["run"]), 4)


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'first' WHEN 'O' THEN 'other' ELSE '' END AS dataset,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'M1' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'M3' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'M2' ELSE '' END AS model FROM orders""")
def a45_tag_run(spark, sf):
    text = F.concat_ws("/", F.lower("o_orderstatus"), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "hi_ur_only").otherwise(F.col("o_orderpriority")))
    out = L.tag_run(table(spark, sf, "orders").withColumn("t", text), "t", {"^f/": "first", "^o/": "other"}, [("low", "M1"), ("only", "M3"), ("high|urgent", "M2")])
    return out.select("o_orderkey", "dataset", "model")


LOGS = ["l_quantity", "l_extendedprice"]


def scale_sql(f: str) -> str:
    return f"""{f}_c AS (SELECT quantile_cont(greatest({f}, 0), 0.99) AS c FROM lineitem), {f}_s AS (SELECT '{f}' AS field, avg(ln(1 + least(greatest({f}, 0), c))) AS m, stddev_pop(ln(1 + least(greatest({f}, 0), c))) AS s,
    quantile_cont(ln(1 + least(greatest({f}, 0), c)), 0.5) AS d, max(c) AS c FROM lineitem CROSS JOIN {f}_c)"""


@query(f"WITH {', '.join(map(scale_sql, LOGS))} SELECT field, 'log1p' AS transform, round(m, 6) AS mean, round(s, 6) AS std, round(d, 6) AS median, round(c, 4) AS clip FROM (SELECT * FROM l_quantity_s UNION ALL SELECT * FROM l_extendedprice_s)")
def a46_fit_scaler(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(rounded(X.scaler_table(li, X.fit_scaler(li, LOGS)), 4, ["clip"]))


def parts(spark, sf):
    return table(spark, sf, "part").withColumn("words", F.split("p_name", " "))


@query("""WITH c AS (SELECT quantile_cont(p_retailprice, 0.99) AS c FROM part), x AS (SELECT *, ln(1 + least(p_retailprice, c)) AS v, row_number() OVER () AS r FROM part CROSS JOIN c),
    s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x), t AS (SELECT list_sort(list(DISTINCT p_type)) AS types FROM part), w AS (SELECT list_sort(list(DISTINCT w)) AS words FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))
    SELECT p_partkey, round((v - m) / s, 4) AS price, len(types) + len(words) + 3 AS dim, CAST(list_position(types, p_type) + 2 AS INT) AS type_at, CAST(len(list_distinct(string_split(p_name, ' '))) AS INT) AS n_words
    FROM x CROSS JOIN s CROSS JOIN t CROSS JOIN w""")
def a47_feature_matrix(spark, sf):
    p = parts(spark, sf)
    vocab = X.vocabulary(p, ["p_type"], ["words"])
    m = X.feature_matrix(p, "p_partkey", X.fit_scaler(p, ["p_retailprice"]), vocab, ["words"])
    k = len(vocab["p_type"])
    total = F.aggregate(F.slice("vector", k + 2, 10_000), F.lit(0.0), lambda a, x: a + x)
    at = F.array_position(F.slice("vector", 2, k), F.lit(1.0).cast("float")) + 1
    return m.select("p_partkey", F.round(F.col("vector")[0].cast("double"), 4).alias("price"), F.col("dim").cast("long").alias("dim"), at.cast("int").alias("type_at"), total.cast("int").alias("n_words"))


@query("""WITH c AS (SELECT quantile_cont(p_retailprice, 0.99) AS c FROM part), x AS (SELECT *, ln(1 + least(p_retailprice, c)) AS v FROM part CROSS JOIN c), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x),
    v AS (SELECT DISTINCT 1 AS b, p_type AS token FROM part UNION SELECT DISTINCT 2, unnest(string_split(p_name, ' ')) FROM part), k AS (SELECT b, token, row_number() OVER (PARTITION BY b ORDER BY token) AS i FROM v),
    n AS (SELECT 1 + count(*) FILTER (b = 1) AS types, 1 + count(*) FILTER (b = 2) AS words FROM v),
    o AS (SELECT DISTINCT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 1 + k.i END AS slot FROM part JOIN k ON b = 1 AND token = p_type
        UNION SELECT p_partkey, 1 + types + k.i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) p JOIN k ON b = 2 AND token = w CROSS JOIN n)
    SELECT p_partkey, 1 + types + words AS dim, list_prepend(0, list(slot ORDER BY slot)) AS indices, round(any_value((v - m) / s), 4) AS price, count(*) AS ones
    FROM o JOIN x USING (p_partkey) CROSS JOIN s CROSS JOIN n GROUP BY p_partkey, types, words""")
def a47_sparse_features(spark, sf):
    """Every fourth part has a type that the vocabulary doesn't have."""
    p = parts(spark, sf)
    vocab = D.build_vocab(p, ["p_type"], ["words"])
    some = p.withColumn("p_type", F.when(F.col("p_size") % 4 == 0, F.lit("another")).otherwise(F.col("p_type")))
    m = X.sparse_features(some, "p_partkey", X.fit_scaler(p, ["p_retailprice"]), vocab, ["p_type"], ["words"])
    ones = F.size(F.filter("values", lambda v: v == 1.0)) - (F.col("values")[0] == 1.0).cast("int")
    return m.select("p_partkey", F.col("dim").cast("long").alias("dim"), "indices", F.round(F.col("values")[0].cast("double"), 4).alias("price"), ones.cast("long").alias("ones"))


@query("""WITH v AS (SELECT DISTINCT 'p_type' AS field, p_type AS token FROM part WHERE p_size > 25 UNION SELECT DISTINCT 'words', unnest(string_split(p_name, ' ')) FROM part WHERE p_partkey % 50 = 1),
    t AS (SELECT 'p_type' AS field, p_type AS token FROM part UNION ALL SELECT 'words', unnest(list_distinct(string_split(p_name, ' '))) FROM part)
    SELECT f.field, count(t.token) AS unknown FROM (VALUES ('p_type'), ('words')) f(field) LEFT JOIN (SELECT * FROM t ANTI JOIN v USING (field, token)) t USING (field) GROUP BY f.field""")
def a48_unknown_by_table(spark, sf):
    p = parts(spark, sf)
    vocab = D.build_vocab(p.filter("p_size > 25"), ["p_type"]).unionByName(D.build_vocab(p.filter("p_partkey % 50 = 1"), [], ["words"]))
    return X.unknown_counts(p, vocab, ["words"], ["p_type"])


@query("""WITH t AS (SELECT 'p_type' AS f, 'unknown' AS v, 0 AS o UNION ALL SELECT DISTINCT 'p_type', p_type, 1 FROM part), u AS (SELECT 'words' AS f, 'unknown' AS v, 0 AS o UNION ALL SELECT DISTINCT 'words', unnest(string_split(p_name, ' ')), 1 FROM part),
    a AS (SELECT 0 AS b, 'numeric' AS kind, 'p_retailprice' AS field, 'log1p z-score' AS value, 0 AS o UNION ALL SELECT 1, 'one_hot', f, v, o FROM t UNION ALL SELECT 2, 'multi_hot', f, v, o FROM u)
    SELECT CAST(row_number() OVER (ORDER BY b, o, value) - 1 AS INT) AS index, kind, field, value FROM a""")
def a48_feature_index(spark, sf):
    p = parts(spark, sf)
    return X.feature_index(p, X.fit_scaler(p, ["p_retailprice"]), X.vocabulary(p, ["p_type"], ["words"]), ["words"])


@query("""SELECT 'p_type' AS field, count(*) FILTER (p_type NOT IN ('SMALL', 'LARGE')) AS unknown FROM part
    UNION ALL SELECT 'words', CAST(sum(len(list_filter(list_distinct(string_split(p_name, ' ')), lambda w: w NOT IN ('red', 'hot')))) AS BIGINT) FROM part""")
def a48_unknown_counts(spark, sf):
    return X.unknown_counts(parts(spark, sf), {"p_type": ["unknown", "SMALL", "LARGE"], "words": ["unknown", "red", "hot"]}, ["words"])


@query("""WITH h AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS h FROM embeddings), p AS (SELECT *, lag(h) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM h)
    SELECT vec_id, label, round(CASE WHEN q IS NOT NULL THEN sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(h, q), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(h) * list_sum(q)))) END, 5) AS distance FROM p""")
def v1_hist_distance(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"))
    return rounded(V.hist_distance(e, "label", "vec_id", "h").select("vec_id", "label", "distance"), 5)


def frames(spark, sf):
    """Events of a user as frames, the change of value as the distance."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", (F.row_number().over(w) - 1).alias("frame"), (F.abs(F.col("value") - F.lag("value").over(w)) / 100).alias("distance"))


FRAMES = """f AS (SELECT user_id, row_number() OVER w - 1 AS frame, abs(value - lag(value) OVER w) / 100 AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
CUTS = f"""RECURSIVE {FRAMES}, k AS (SELECT user_id, frame FROM f WHERE d > 0.55), r AS (SELECT user_id, min(frame) AS frame FROM k GROUP BY user_id
    UNION ALL SELECT r.user_id, (SELECT min(k.frame) FROM k WHERE k.user_id = r.user_id AND k.frame >= r.frame + 3) FROM r WHERE r.frame IS NOT NULL),
    cut AS (SELECT user_id, frame FROM r WHERE frame IS NOT NULL)"""
SHOTS = f"""{CUTS}, v AS (SELECT user_id, count(*) AS n FROM f GROUP BY user_id), b AS (SELECT user_id, frame AS s FROM cut UNION ALL SELECT user_id, 0 FROM v),
    sh AS (SELECT user_id, n, CAST(row_number() OVER w - 1 AS INT) AS shot_no, s, coalesce(lead(s) OVER w, n) - 1 AS e FROM b JOIN v USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY s))"""


@query(f"WITH {CUTS} SELECT user_id, array_to_string(list(frame ORDER BY frame), ',') AS cuts FROM cut GROUP BY user_id")
def v2_detect_cuts(spark, sf):
    cuts = V.detect_cuts(frames(spark, sf), "user_id", "frame", "distance", gap=3)
    return cuts.select("user_id", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


def shots(spark, sf):
    f = frames(spark, sf)
    videos = f.groupBy("user_id").agg(F.count("*").alias("frames")).withColumn("fps", F.lit(4.0))
    return V.cuts_to_shots(videos, V.detect_cuts(f, "user_id", "frame", "distance", gap=3), "user_id", "frames", "fps"), videos


@query(f"WITH {SHOTS} SELECT user_id, shot_no, s AS start, e AS end, s / 4 AS start_sec, e / 4 AS end_sec, (s + e) // 2 AS mid FROM sh")
def v3_cuts_to_shots(spark, sf):
    return shots(spark, sf)[0]


@query(f"""WITH {SHOTS} SELECT user_id, count(*) AS num_shots, round(avg((e - s + 1) / 4), 6) AS avg_shot_len_sec, round((count(*) - 1) / (max(n) / 4) * 30, 6) AS cuts_per_30s,
    CASE WHEN (count(*) - 1) / (max(n) / 4) * 30 >= 8 THEN 'very fast' WHEN (count(*) - 1) / (max(n) / 4) * 30 >= 5 THEN 'fast' WHEN (count(*) - 1) / (max(n) / 4) * 30 >= 3 THEN 'moderate' ELSE 'slow' END AS editing_rhythm,
    count(*) FILTER (shot_no % 2 = 0) AS pan, count(*) FILTER (shot_no % 2 = 1) AS tilt FROM sh GROUP BY user_id""")
def v4_video_stats(spark, sf):
    s, videos = shots(spark, sf)
    s = s.withColumn("move", F.when(F.col("shot_no") % 2 == 0, "pan").otherwise("tilt"))
    return rounded(V.video_stats(s, videos, "user_id", "frames", "fps", "move", ["pan", "tilt"]))


@query("""SELECT o_orderkey, 0 AS seg_no, o_custkey % 50 + 1 AS n_frames, round((o_custkey % 50 + 1) / 25, 6) AS seconds, round(least((o_custkey % 50 + 1) / 40, 1), 6) AS ratio FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 1, 1, 0.04, 0.025 FROM orders""")
def v5_segment_durations(spark, sf):
    pair = lambda a, b: F.array(F.lit(a).cast("long"), b.cast("long"))
    first = F.when(F.col("o_orderkey") % 3 == 0, pair(10, F.col("o_custkey") % 50 + 10)).when(F.col("o_orderkey") % 3 == 1, pair(0, F.lit(0))).otherwise(pair(-1, F.lit(-1)))
    o = table(spark, sf, "orders").select("o_orderkey", F.array(first, pair(5, F.lit(5))).alias("segs"), F.lit(25).alias("fps"), F.lit(40).alias("frames"))
    return rounded(V.segment_durations(o, "o_orderkey", "segs", "fps", "frames"))


def code_sql(step: float) -> str:
    n = round(1 / step)
    at = ", ".join(str(i / n) for i in range(n + 1))
    return f"WITH e AS (SELECT quantile_cont(o_totalprice, [{at}]) AS e FROM orders) SELECT o_orderkey, CAST(len(list_filter(e, lambda y: y < o_totalprice)) AS INT) AS code FROM orders CROSS JOIN e"


@query(code_sql(0.01))
def v6_quantile_code_absolute(spark, sf):
    return V.quantile_code(table(spark, sf, "orders"), "o_totalprice", 0.01).select("o_orderkey", "code")


@query(code_sql(0.02))
def v6_quantile_code_relative(spark, sf):
    return V.quantile_code(table(spark, sf, "orders"), "o_totalprice", 0.02).select("o_orderkey", "code")


@query("SELECT 'b' || CAST(conv_id % 40 AS VARCHAR) AS video_id, count(*) AS n, true AS good FROM conversations WHERE conv_id % 40 % 3 <> 1 GROUP BY 1 UNION ALL SELECT DISTINCT NULL, conv_id % 40, false FROM conversations WHERE conv_id % 40 % 3 = 1")
def s1_compacted(spark, sf):
    """Groups of conversations as a document in a file each, some broken, gathered once and read from there."""
    path, target, b = shared_path(spark, "small"), shared_path(spark, "compacted"), F.col("conv_id") % 40
    docs = table(spark, sf, "conversations").groupBy(b.alias("b")).agg(F.count("*").alias("n"))
    text = F.when(F.col("b") % 3 != 1, F.to_json(F.struct(F.concat(F.lit("b"), F.col("b").cast("string")).alias("video_id"), "n"))).otherwise(F.lit('{"video_id": '))
    docs.select("b", text.alias("value")).write.partitionBy("b").text(path)
    IO.compact(spark, path, target)
    IO.compact(spark, path, target)
    good, bad = IO.parse_annotations(IO.read_compacted(spark, target), "video_id string, n bigint")
    none = bad.select(F.lit(None).cast("string").alias("video_id"), F.regexp_extract("file", "b=([0-9]+)/", 1).cast("bigint").alias("n"), F.lit(False).alias("good"))
    return good.select("video_id", "n", F.lit(True).alias("good")).unionByName(none)


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS video_id, turn AS n, true AS good FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT NULL, NULL, false FROM conversations WHERE turn % 3 <> 0")
def s1_read_annotations(spark, sf):
    """Conversations written as JSON documents, some broken or without an id, and read back."""
    path, c = shared_path(spark, "annotations"), table(spark, sf, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    k = F.col("turn") % 3
    text = F.when(k == 0, F.to_json(F.struct(key.alias("video_id"), F.struct(F.col("turn").alias("n")).alias("stats")))).when(k == 1, F.lit('{"video_id": "x", ')).otherwise(F.lit('{"stats": {"n": 1}}'))
    c.select(text.alias("value")).write.text(path)
    # one document a line: a file for each document would be millions of files
    good, bad = IO.read_annotations(spark, path, "video_id string, stats struct<n: bigint>", one_per_file=False)
    none = bad.select(F.lit(None).cast("string").alias("video_id"), F.lit(None).cast("bigint").alias("n"), F.lit(False).alias("good"))
    return good.select("video_id", "stats.n", F.lit(True).alias("good")).unionByName(none)


@query("SELECT CAST(doc_id AS VARCHAR) AS video_id, toxic AS label FROM labels WHERE doc_id % 5 <> 0")
def s2_read_labels(spark, sf):
    path = shared_path(spark, "labels")
    kind = F.when(F.col("doc_id") % 5 == 0, "?").when(F.col("toxic") == 1, "Fake").otherwise("real")
    table(spark, sf, "labels").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("video_id"), kind.alias("annotation"))).alias("value")).write.text(path)
    return IO.read_labels(spark, path, ["real"], ["fake"]).select("video_id", "label")


@query("SELECT CAST(doc_id AS VARCHAR) AS vid, quality AS label, toxic AS pred_m1, CAST(quality <> toxic AS INT) AS wrong_m1 FROM labels")
def s3_read_predictions(spark, sf):
    path = shared_path(spark, "predictions")
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("vid"), F.col("quality").alias("label"), F.col("toxic").alias("pred"), P.wrong_flag("toxic", "quality").alias("wrong"))
    rows.write.option("header", True).csv(path)
    return IO.read_predictions(spark, path, "m1")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def s8_write_report(spark, sf):
    from cairn.operators.describe import value_counts

    path = shared_path(spark, "report")
    IO.write_report(value_counts(table(spark, sf, "documents"), ["lang", "source"]), path)
    return spark.read.parquet(path).select("field", "value", "n")


@query("""WITH c AS (SELECT quantile_cont(p_retailprice, 0.99) AS c FROM part), x AS (SELECT *, ln(1 + least(p_retailprice, c)) AS v FROM part CROSS JOIN c), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x),
    t AS (SELECT list_sort(list(DISTINCT p_type)) AS types FROM part)
    SELECT p_partkey, CAST(len(types) + 2 AS INT) AS dim, '1' AS version, round((v - m) / s, 4) AS price, CAST(list_position(types, p_type) + 2 AS INT) AS type_at FROM x CROSS JOIN s CROSS JOIN t""")
def s9_write_features(spark, sf):
    path, p = shared_path(spark, "features"), parts(spark, sf)
    IO.write_features(X.feature_matrix(p, "p_partkey", X.fit_scaler(p, ["p_retailprice"]), X.vocabulary(p, ["p_type"]), layout="reduced"), path)
    at = F.array_position(F.slice("vector", 2, 10_000), F.lit(1.0).cast("float")).cast("int") + 1
    return spark.read.parquet(path).select("p_partkey", "dim", "version", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("price"), at.alias("type_at"))


@query("""WITH c AS (SELECT quantile_cont(p_retailprice, 0.99) AS c FROM part), x AS (SELECT *, ln(1 + least(p_retailprice, c)) AS v FROM part CROSS JOIN c), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x)
    SELECT p_partkey, round((v - m) / s, 4) AS price, CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS large, 2 AS dim FROM x CROSS JOIN s""")
def a47_flags_layout(spark, sf):
    p = parts(spark, sf)
    m = X.feature_matrix(p, "p_partkey", X.fit_scaler(p, ["p_retailprice"]), {}, flags={"large": P.flag(F.col("p_size") > 25)}, layout="flags")
    at = lambda i: F.get("vector", F.lit(i)).cast("double")
    return m.select("p_partkey", F.round(at(0), 4).alias("price"), at(1).alias("large"), "dim")
