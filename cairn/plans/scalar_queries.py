"""Scalar functions and keyed joins on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as P
from cairn.operators import keys as K
from cairn.plans.base import query, rounded, table

COLOURS = {"red": "rot", "blue": "blau", "hot": "heiss"}


@query("""SELECT event_id, COALESCE(CAST(json_extract(props, '$.k') AS INT), -1) AS k, -1 AS absent FROM events""")
def p1_get_path(spark, sf):
    df = table(spark, sf, "events").withColumn("doc", F.from_json("props", "k int"))
    return df.select("event_id", P.get_path(df, "doc.k", -1).alias("k"), P.get_path(df, "doc.no.such", -1).alias("absent"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS DOUBLE) END AS x FROM orders")
def p2_to_double(spark, sf):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.col("o_custkey").cast("string")).when(k == 1, "n/a").otherwise("NaN")
    return table(spark, sf, "orders").select("o_orderkey", P.to_double(text).alias("x"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(' ' || replace(p_name, ' ', ' | ') || '| |', '|'), lambda x: trim(x)),
    lambda x: x <> ''), '|') AS joined FROM part""")
def p3_split_multi(spark, sf):
    text = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit("| |"))
    return table(spark, sf, "part").select("p_partkey", P.join_multi(P.split_multi(text)).alias("joined"))


@query("""SELECT p_partkey, lower(replace(replace(replace(replace('(' || p_type || ')- ' || p_name, '/', '_'), '-', '_'), ' ', '_'), '__', '_')) AS token FROM part""")
def p4_canon_token(spark, sf):
    text = F.concat(F.lit(" （"), "p_type", F.lit("）- "), "p_name", F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", P.canon_token(text).alias("token"))


@query("""SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'rot' WHEN 'blue' THEN 'blau' WHEN 'hot' THEN 'heiss' ELSE split_part(p_name, ' ', 1) END AS first_word,
    array_to_string(list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'red' THEN 'rot' WHEN 'blue' THEN 'blau' WHEN 'hot' THEN 'heiss' ELSE x END), '|') AS words,
    CASE WHEN p_type = 'SMALL' THEN 'klein' ELSE p_type END AS map_key, CASE WHEN p_type = 'SMALL' THEN 'klein=2' ELSE p_type || '=1|klein=2' END AS merged FROM part""")
def p5_translate(spark, sf):
    words = F.split("p_name", " ")
    renamed = P.translate_map_keys(F.create_map("p_type", F.lit(1)), {"SMALL": "klein"})
    merged = P.translate_map_keys(F.create_map("p_type", F.lit(1), F.lit("klein "), F.lit(2)), {"SMALL": "klein"})  # keys may meet
    pairs = F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return table(spark, sf, "part").select(
        "p_partkey", P.translate_values(words[0], COLOURS).alias("first_word"),
        F.array_join(P.translate_values(words, COLOURS, is_list=True), "|").alias("words"), F.map_keys(renamed)[0].alias("map_key"), P.join_multi(pairs).alias("merged"),
    )


@query("""SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS words
    FROM (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' ') AS w FROM part)""")
def p6_dedupe_list(spark, sf):
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name"), " ")
    return table(spark, sf, "part").select("p_partkey", P.join_multi(P.dedupe_list(words)).alias("words"))


@query("""SELECT o_orderkey, 'stats.price' AS field, 'num' AS kind, o_totalprice AS num_value, NULL AS cat_value FROM orders
    UNION ALL SELECT o_orderkey, 'stats.more.status', 'cat', NULL, o_orderstatus FROM orders
    UNION ALL SELECT o_orderkey, 'analysis.priority', 'cat', NULL, o_orderpriority FROM orders""")
def p7_flatten_long(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.struct(F.col("o_orderstatus").alias("status")).alias("more")).alias("stats"),
        F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("skipped")).alias("analysis"),
    )
    return P.flatten_long(o, "o_orderkey", ["stats", "analysis"], ignore=["skipped"]).drop("list_value")


@query("""SELECT CASE lower(l_linestatus) WHEN 'f' THEN 0 WHEN 'o' THEN 1 END AS label, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""")
def p8_map_label(spark, sf):
    return table(spark, sf, "lineitem").groupBy(P.map_label(F.concat("l_linestatus", F.lit(" ")), ["f"], ["o"]).alias("label"), "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS value FROM orders")
def p9_coalesce_fields(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.coalesce_fields(F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderstatus")), "o_orderpriority").alias("value"))


@query("""SELECT CASE WHEN l_quantity / 5 >= 8 THEN 'very fast' WHEN l_quantity / 5 >= 5 THEN 'fast' WHEN l_quantity / 5 >= 3 THEN 'moderate' ELSE 'slow' END AS rhythm,
    CASE WHEN l_discount * 3 > 0.23 THEN 'high_contrast' WHEN l_discount * 3 > 0.12 THEN 'medium_contrast' ELSE 'soft_low_contrast' END AS contrast,
    CASE WHEN l_tax * 11 > 0.7 THEN 'bright_sunny' WHEN l_tax * 11 > 0.45 THEN 'overcast_neutral' ELSE 'dim_low_light' END AS brightness,
    CASE WHEN l_tax > l_discount THEN 'cool_tone' WHEN l_discount > l_tax THEN 'warm_tone' ELSE 'neutral_tone' END AS temperature,
    count(*) AS n FROM lineitem GROUP BY ALL""")
def p10_threshold_labels(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        P.label_rhythm(F.col("l_quantity") / 5).alias("rhythm"), P.label_contrast(F.col("l_discount") * 3).alias("contrast"),
        P.label_brightness(F.col("l_tax") * 11).alias("brightness"), P.label_temperature("l_tax", "l_discount").alias("temperature"),
    ).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN abs(sqrt(greatest(1e-6, (1 + l_tax) * (1 + l_tax) + l_discount * l_discount)) - 1) > 0.02 THEN
      CASE WHEN sqrt(greatest(1e-6, (1 + l_tax) * (1 + l_tax) + l_discount * l_discount)) > 1 THEN 'dolly_in' ELSE 'dolly_out' END
    WHEN abs(l_quantity - 25) > abs(l_linenumber - 4) AND abs(l_quantity - 25) > 2 THEN 'pan_horizontal' WHEN abs(l_linenumber - 4) > 2 THEN 'tilt_vertical'
    ELSE 'static_shot' END AS motion, count(*) AS n FROM lineitem GROUP BY ALL""")
def p11_motion(spark, sf):
    motion = P.label_motion(F.col("l_quantity") - 25, F.col("l_linenumber") - 4, 1 + F.col("l_tax"), "l_discount")
    return table(spark, sf, "lineitem").groupBy(motion.alias("motion")).agg(F.count("*").alias("n"))


TAXONOMY = {"shots": ["red", "blue", "bolt", "ring"], "tone": ["SMALL", "LARGE", "ECONOMY"]}


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'rod' THEN 'bolt' ELSE x END), lambda x: x IN ('red', 'blue', 'bolt', 'ring')), '|') AS shots,
    CASE WHEN p_type IN ('SMALL', 'LARGE', 'ECONOMY') THEN p_type ELSE '' END AS tone, round(greatest(0, least(1, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size / 40.0 END)), 6) AS score,
    array_to_string(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x IN ('red', 'blue', 'bolt', 'ring', 'SMALL', 'LARGE', 'ECONOMY')), '|') AS tags,
    CASE WHEN p_size % 3 = 0 THEN '' WHEN split_part(p_name, ' ', 1) IN ('red', 'hot') THEN split_part(p_name, ' ', 1) ELSE '' END AS colour FROM part""")
def p12_clamp(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.split("p_name", " ").alias("shots"), F.col("p_type").alias("tone"),
        F.when(F.col("p_size") % 5 == 0, "bad").otherwise((F.col("p_size") / 40).cast("string")).alias("score"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tags"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.split("p_name", " ")[0]).alias("colour"),
    )
    out = P.clamp_to_taxonomy(p, {**TAXONOMY, "colour": ["red", "hot"]}, {"shots": {"rod": "bolt"}}, ["shots", "colour"], ["tone"], "score", "tags")
    every = F.array(*map(F.lit, (v for vs in TAXONOMY.values() for v in vs)))
    return rounded(out.withColumns({"shots": P.join_multi("shots"), "tags": P.join_multi(F.filter("tags", lambda t: F.array_contains(every, t))), "colour": P.join_multi("colour")}))


@query("""SELECT l_returnflag, movement, tone, count(*) AS n FROM (SELECT l_returnflag,
      CASE WHEN l_linenumber - 3 <= 0 AND l_tax * 100 - 4 <= 0 THEN NULL WHEN l_linenumber - 3 >= round(l_tax * 100) - 4 THEN 'pan' ELSE 'tilt' END AS movement,
      CASE WHEN l_linestatus = 'O' THEN 'documentary_style|narrative_style|warm_mood' ELSE 'documentary_style|narrative_style' END AS tone FROM lineitem) GROUP BY ALL""")
def p13_fallback(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", F.create_map(F.lit("pan"), F.col("l_linenumber").cast("int") - 3, F.lit("tilt"), F.round(F.col("l_tax") * 100).cast("int") - 4).alias("moves"),
        F.lit("slow").alias("rhythm"), F.when(F.col("l_linestatus") == "O", "warm_tone").alias("tone"), F.lit(None).cast("string").alias("contrast"),
    )
    out = P.fallback_annotation(li, "moves", "rhythm", "tone", "contrast", ["pan", "tilt"])
    return out.groupBy("l_returnflag", F.get("camera_movements", F.lit(0)).alias("movement"), P.join_multi("overall_style").alias("tone")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS pct, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS mib FROM part")
def p14_units(spark, sf):
    mib = F.when(F.col("p_size") % 7 == 0, "[N/A]").otherwise(F.concat(F.col("p_retailprice").cast("string"), F.lit(" MiB")))
    return table(spark, sf, "part").select("p_partkey", P.parse_percent(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" %"))).alias("pct"), P.parse_mib(mib).alias("mib"))


@query("""SELECT p_partkey, p_retailprice AS acc, CAST(p_size AS DOUBLE) AS f1, p_brand AS arg_brand, CAST(p_size AS VARCHAR) AS arg_size FROM part""")
def p15_pydict(spark, sf):
    s = lambda c: F.col(c).cast("string")
    p = table(spark, sf, "part")
    d = P.parse_pydict(F.concat(F.lit("best: {'ACC': "), s("p_retailprice"), F.lit(", 'f1': "), s("p_size"), F.lit("} done")))
    n = P.parse_namespace(F.concat(F.lit("Namespace(Brand='"), "p_brand", F.lit("', size="), s("p_size"), F.lit(")")))
    return p.select("p_partkey", d["acc"].alias("acc"), d["f1"].alias("f1"), n["brand"].alias("arg_brand"), n["size"].alias("arg_size"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_custkey % 7200 END AS INT) AS seconds,
    CASE WHEN o_orderkey % 5 = 4 THEN '' WHEN o_custkey % 7200 >= 3600 THEN printf('%02d:%02d:%02d', (o_custkey % 7200) // 3600, (o_custkey % 3600) // 60, o_custkey % 60)
    ELSE printf('%02d:%02d', (o_custkey % 7200) // 60, o_custkey % 60) END AS text FROM orders""")
def p16_duration(spark, sf):
    o = table(spark, sf, "orders").withColumn("n", (F.col("o_custkey") % 7200).cast("int"))
    h, m, s, k = F.floor(F.col("n") / 3600), F.floor(F.col("n") % 3600 / 60), F.col("n") % 60, F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.format_string("%d:%02d:%02d", h, m, s)).when(k == 1, F.format_string("%dh %dm %ds", h, m, s))
        .when(k == 2, F.col("n").cast("string")).when(k == 3, F.format_string("%d:%02d", F.floor(F.col("n") / 60), s)).otherwise("soon")
    )
    seconds = P.parse_duration(text)
    return o.select("o_orderkey", seconds.alias("seconds"), P.format_duration(seconds.cast("double")).alias("text"))


@query(f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN turn WHEN 1 THEN conv_id END AS n, CASE WHEN turn % 3 < 2 THEN role END AS role, true AS object
    FROM (SELECT conv_id, turn, role FROM conversations)""")
def p17_extract_json(spark, sf):
    s, k = (lambda c: F.col(c).cast("string")), F.col("turn") % 3
    body = lambda n: F.concat(F.lit('{"n": '), s(n), F.lit(', "role": "'), "role", F.lit('"'))
    text = (
        F.when(k == 0, F.concat(F.lit('<think>{"n": 0}</think> Answer: ```json\n'), body("turn"), F.lit(",}```")))
        .when(k == 1, F.concat(body("conv_id"), F.lit("}"))).otherwise(F.col("role"))
    )
    out = table(spark, sf, "conversations").select("conv_id", "turn", P.extract_json(text, "n bigint, role string").alias("o"))
    return out.select("conv_id", "turn", "o.n", "o.role", F.col("o").isNotNull().alias("object"))


@query("""SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AND p_type <> 'PROMO' AS valid, valid AS wrapped, valid AS half_wrapped FROM part""")
def p18_valid(spark, sf):
    words, none = F.split("p_name", " "), F.array().cast("array<string>")
    doc = F.struct(
        F.when(F.col("p_size") % 2 == 0, words).otherwise(none).alias("shot_types"), words.alias("camera_movements"), words.alias("composition_styles"), words.alias("overall_style"),
        F.col("p_brand").alias("editing_rhythm"), F.when(F.col("p_type") != "PROMO", "x").otherwise(" ").alias("color_tone"), F.lit("y").alias("lighting_style"),
        F.when(F.col("p_size") % 3 == 0, "high").otherwise("0.5").alias("confidence_score"),
    )
    inner = F.struct(doc.alias("video_analysis"), F.lit("x").alias("other"))
    p = table(spark, sf, "part").select("p_partkey", doc.alias("bare"), F.struct(inner.alias("analysis"), F.lit(1).alias("stats")).alias("row"), inner.alias("half"))
    valid = lambda c: P.is_valid_annotation(P.annotation_of(p, c))
    return p.select("p_partkey", valid("bare").alias("valid"), valid("row").alias("wrapped"), valid("half").alias("half_wrapped"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS text_missing, o_custkey % 2 = 0 AS number_missing FROM orders""")
def p19_missing(spark, sf):
    o = table(spark, sf, "orders").withColumns({
        "t": F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise(" "), "x": F.when(F.col("o_custkey") % 2 == 0, float("nan")).otherwise(F.col("o_totalprice")),
    })
    return o.select("o_orderkey", P.is_missing("t", o.schema["t"].dataType).alias("text_missing"), P.is_missing("x", o.schema["x"].dataType).alias("number_missing"))


@query("""SELECT p_partkey, CASE WHEN p_type IN ('SMALL') THEN 0 ELSE 1 END AS is_fast, CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END AS is_warm,
    CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN 1 ELSE 0 END AS has_pan, CASE WHEN list_has_any(string_split(p_name, ' '), ['hot', 'bolt']) THEN 1 ELSE 0 END AS high_risk,
    CASE WHEN list_has_any(string_split(p_name, ' '), ['cold', 'bolt']) THEN 1 ELSE 0 END AS low_risk, CASE WHEN p_size >= 25 THEN 1 ELSE 0 END AS own_is_fast,
    CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS is_high_contrast FROM part""")
def p20_flags(spark, sf):
    words = F.split("p_name", " ")
    flags = P.risk_flags(
        F.when(F.col("p_type") == "SMALL", "slow").otherwise(" Very Fast"), F.when(F.col("p_brand") == "Brand#1", "Warm tone"),
        F.when(F.col("p_size") % 2 == 0, "High-Contrast").otherwise("x"), P.translate_values(words, {"red": "Pan/Horizontal"}, is_list=True), words, ["hot", "bolt"], ["cold", "bolt"],
    )
    own = P.risk_flags(P.label_rhythm(F.col("p_size") / 5), F.lit("x"), F.lit("x"), words, words, ["hot"], ["cold"])["is_fast"]
    names = ("is_fast", "is_warm", "is_high_contrast", "has_pan", "high_risk", "low_risk")
    return table(spark, sf, "part").select("p_partkey", *[flags[n].alias(n) for n in names], own.alias("own_is_fast"))


@query("""SELECT p_partkey, round(greatest(p_size - 10, 0) / greatest(p_size % 7, 1), 6) AS per_shot,
    round(greatest(p_size - 10, 0) / greatest((p_size % 7) * p_retailprice / 30.0, 1e-6), 6) AS per_30s FROM part""")
def p21_rates(spark, sf):
    a, b = P.movement_rates(F.col("p_size") - 10, F.col("p_size") % 7, "p_retailprice")
    return rounded(table(spark, sf, "part").select("p_partkey", a.alias("per_shot"), b.alias("per_30s")))


@query("""SELECT CAST(l.quality <> CAST(d.n_chars >= 800 AS INT) AS INT) AS wrong, CAST(l.quality AS VARCHAR) || '×' || d.lang AS key, count(*) AS n
    FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL""")
def p22_flags(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    wrong = P.wrong_flag((F.col("n_chars") >= 800).cast("int"), "quality")
    return d.groupBy(wrong.alias("wrong"), P.composite_key("quality", "lang").alias("key")).agg(F.count("*").alias("n"))


@query("""SELECT vec_id, round(list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 3 = 0)[1:20], lambda x: CAST(x AS DOUBLE))), 5) AS thin,
    CAST(least(len(embedding), 20) AS INT) AS thin_mask, CAST(greatest(len(embedding), 80) AS INT) AS padded, CAST(least(len(embedding), 80) AS INT) AS pad_mask,
    array_to_string(list_concat(list_transform(range(0, vec_id % 6), lambda i: CAST(i AS VARCHAR) || ',' || CAST(vec_id AS VARCHAR)), list_transform(range(0, 4), lambda i: '-1,-1'))[1:4], '|') AS segments FROM embeddings""")
def p23_fix_length(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    numbers = F.when(F.col("vec_id") % 6 > 0, F.sequence(F.lit(0), (F.col("vec_id") % 6).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    segments = F.transform(numbers, lambda i: F.array(i, F.col("vec_id").cast("int")))
    e = e.select("vec_id", P.fix_length("v", 20).alias("s"), P.fix_length("v", 80).alias("l"), P.pad_segments(segments, 4).alias("p"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    ones = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    text = F.array_join(F.transform("p", lambda x: F.array_join(x.cast("array<string>"), ",")), "|")
    return e.select("vec_id", F.round(total("s.values"), 5).alias("thin"), ones("s.mask").alias("thin_mask"), F.size("l.values").alias("padded"), ones("l.mask").alias("pad_mask"), text.alias("segments"))


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def k1_join_labels(spark, sf):
    return K.join_labels(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def k2_keep_first(spark, sf):
    return K.keep_first(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def predictions(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), F.col("quality").alias("label"),
                    (F.col("n_chars") >= 800).cast("int").alias("pred_base"), (F.col("n_chars") >= 400).cast("int").alias("pred_new"))


PREDICTIONS = """(SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars, quality AS label, CAST(n_chars >= 800 AS INT) AS pred_base,
    CAST(n_chars >= 400 AS INT) AS pred_new FROM documents JOIN labels USING (doc_id))"""


@query(f"SELECT doc_id, label, pred_base, pred_new, lang FROM {PREDICTIONS}")
def k3_join_predictions(spark, sf):
    p = predictions(spark, sf)
    side = lambda c: p.select("doc_id", "label", F.col(c).alias("pred"))
    return K.join_predictions(side("pred_base"), side("pred_new"), table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def k4_filter_split(spark, sf):
    return K.filter_split(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT doc_id, COALESCE(round(CAST(e.embedding[1] AS DOUBLE), 5), 0) AS first, COALESCE(len(e.embedding), 64) AS dim FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def k5_attach_features(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = K.attach_features(table(spark, sf, "documents").select("doc_id"), e, "doc_id", "embedding", 64)
    return out.select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def k6_pending_items(spark, sf):
    return K.pending_items(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", F.col("toxic") == 0)


RECONCILE = "i AS (SELECT doc_id FROM documents WHERE lang <> 'en'), o AS (SELECT * FROM labels)"


@query(f"""WITH {RECONCILE}, c AS (SELECT (SELECT count(*) FROM o) AS outputs, (SELECT count(*) FROM i WHERE doc_id IN (SELECT doc_id FROM o)) AS matched,
    (SELECT count(*) FROM i WHERE doc_id NOT IN (SELECT doc_id FROM o)) AS unprocessed, (SELECT count(*) FROM o WHERE toxic <> 0) AS invalid,
    (SELECT count(*) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM i)) AS orphan) SELECT *, invalid + orphan AS anomalies, unprocessed + invalid + orphan AS estimate FROM c""")
def k7_reconcile(spark, sf):
    return K.reconcile(table(spark, sf, "documents").filter("lang <> 'en'").select("doc_id"), table(spark, sf, "labels"), "doc_id", F.col("toxic") == 0)


@query(f"""WITH {RECONCILE} SELECT doc_id, 'invalid' AS reason FROM o WHERE toxic <> 0 UNION ALL SELECT doc_id, 'orphan' FROM o WHERE doc_id NOT IN (SELECT doc_id FROM i)""")
def k7_failures(spark, sf):
    return K.failures(table(spark, sf, "documents").filter("lang <> 'en'").select("doc_id"), table(spark, sf, "labels"), "doc_id", F.col("toxic") == 0)


@query(f"""WITH {RECONCILE}, f AS (SELECT doc_id, 'invalid' AS reason FROM o WHERE toxic <> 0 UNION ALL SELECT doc_id, 'orphan' FROM o WHERE doc_id NOT IN (SELECT doc_id FROM i))
    SELECT reason, count(*) AS n FROM f GROUP BY reason UNION ALL SELECT 'total', count(*) FROM f""")
def k7_failure_report(spark, sf):
    failed = K.failures(table(spark, sf, "documents").filter("lang <> 'en'").select("doc_id"), table(spark, sf, "labels"), "doc_id", F.col("toxic") == 0)
    return K.failure_report(failed)


@query("""SELECT CAST(doc_id AS VARCHAR) || '.json' AS file, 'out/' || CAST(doc_id AS VARCHAR) || '.json' AS path,
    CASE WHEN quality = 0 THEN '' ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S') END AS modified, CASE WHEN toxic = 0 THEN 'NO' ELSE 'YES' END AS is_empty FROM labels""")
def k7_output_detail(spark, sf):
    at = F.when(F.col("quality") != 0, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")))
    outputs = table(spark, sf, "labels").select(F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("p"), at.alias("t"), "toxic")
    return K.output_detail(outputs, "p", "t", F.col("toxic") == 0)
