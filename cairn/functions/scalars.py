"""Column functions on annotation documents. They take columns or names and return columns; text that can't be read gives null."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path, or None."""
    now: T.DataType = schema
    for part in path.split("."):
        if not isinstance(now, T.StructType) or part not in now.names:
            return None
        now = now[part].dataType
    return now


def get_path(df: DataFrame, path: str, default=None) -> Column:
    """P1. The value at a dotted path of df; the default where the path or the value is missing."""
    fallback = F.lit(default)
    return fallback if type_at(df.schema, path) is None else F.coalesce(F.col(path), fallback)


def to_double(c: Column | str) -> Column:
    """P2. A number, or null for what isn't one; NaN becomes null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def split_multi(c: Column | str, is_list: bool = False) -> Column:
    """P3. 'a | b' or a list -> trimmed, non-empty items; null stays null."""
    items = col(c) if is_list else F.split(col(c), r"\|")
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def join_multi(c: Column | str) -> Column:
    return F.array_join(col(c), "|")


def canon_token(c: Column | str) -> Column:
    """P4. Trimmed, half-width brackets, '/', '-' and spaces as '_', one pass over doubled '_', lower case."""
    return F.lower(F.replace(F.translate(F.trim(col(c)), "（）/- ", "()___"), F.lit("__"), F.lit("_")))


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def translate_values(c: Column | str, mapping: Mapping[str, str], is_list: bool = False) -> Column:
    """P5. Values, or each item of a list, by a small dictionary; unknown ones pass through trimmed."""
    one = lambda x: F.coalesce(_lookup(mapping, F.trim(x)), F.trim(x))
    return F.transform(col(c), one) if is_list else one(col(c))


def translate_map_keys(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """P5. Keys of a map. Of keys that become equal the later entry stays, in its place."""
    one = lambda k: F.coalesce(_lookup(mapping, F.trim(k)), F.trim(k))
    entries = F.transform(F.map_entries(col(c)), lambda e: F.struct(one(e["key"]).alias("key"), e["value"].alias("value")))

    def last_ones(es: Column) -> Column:
        again = lambda e, i: F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"])
        return F.map_from_entries(F.filter(es, lambda e, i: ~again(e, i)))

    return let(entries, last_ones)


def dedupe_list(c: Column | str) -> Column:
    """P6. First occurrences, in order."""
    return F.array_distinct(col(c))


def leaves(schema: T.StructType, groups: Sequence[str] | None = None, ignore: Sequence[str] = (), prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths and types of all leaves; lists and maps stay leaves."""
    out = []
    for f in schema.fields:
        if not prefix and groups is not None and f.name not in groups:
            continue
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, None, ignore, f"{prefix}{f.name}.")
        elif f.name not in ignore:
            out.append((f"{prefix}{f.name}", f.dataType))
    return out


def flatten_long(df: DataFrame, id_col: str, groups: Sequence[str] | None = None, ignore: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """P7. One row per entity and leaf: id, the kept columns, field, kind ('num', 'cat' or 'list'), num_value, cat_value, list_value."""
    cells = []
    for path, kind in leaves(df.schema, groups, (*ignore, id_col, *keep)):
        is_list, is_num = isinstance(kind, T.ArrayType), isinstance(kind, T.NumericType)
        if isinstance(kind, T.MapType):
            continue
        cells.append(
            F.struct(
                F.lit(path).alias("field"),
                F.lit("list" if is_list else "num" if is_num else "cat").alias("kind"),
                (to_double(path) if is_num else F.lit(None).cast("double")).alias("num_value"),
                (F.lit(None) if is_list or is_num else F.col(path)).cast("string").alias("cat_value"),
                (F.col(path) if is_list else F.lit(None)).cast("array<string>").alias("list_value"),
            )
        )
    return df.select(id_col, *keep, F.inline(F.array(*cells)))


def map_label(c: Column | str, zero: Sequence[str], one: Sequence[str]) -> Column:
    """P8. 0 or 1 by two vocabularies; anything else is null. Which side is which is the caller's choice."""
    x = F.lower(F.trim(col(c)))
    return F.when(x.isin(*zero), 0).when(x.isin(*one), 1)


def coalesce_fields(*cols: Column | str) -> Column:
    """P9. The first text that isn't blank."""
    return F.coalesce(*[F.when(F.trim(col(c)) != "", F.trim(col(c))) for c in cols])


def label_rhythm(cuts_per_30s: Column | str) -> Column:
    """P10."""
    x = col(cuts_per_30s)
    return F.when(x >= 8, "very fast").when(x >= 5, "fast").when(x >= 3, "moderate").when(x.isNotNull(), "slow")


def label_contrast(v_std: Column | str) -> Column:
    x = col(v_std)
    return F.when(x > 0.23, "high_contrast").when(x > 0.12, "medium_contrast").when(x.isNotNull(), "soft_low_contrast")


def label_brightness(v_mean: Column | str) -> Column:
    x = col(v_mean)
    return F.when(x > 0.7, "bright_sunny").when(x > 0.45, "overcast_neutral").when(x.isNotNull(), "dim_low_light")


def label_temperature(cold: Column | str, warm: Column | str) -> Column:
    a, b = col(cold), col(warm)
    return F.when(a > b, "cool_tone").when(b > a, "warm_tone").when((a == b), "neutral_tone")


def label_motion(dx, dy, a11, a21) -> Column:
    """P11. Camera motion of an affine step."""
    x, y = F.abs(col(dx)), F.abs(col(dy))
    scale = F.sqrt(F.greatest(F.lit(1e-6), col(a11) * col(a11) + col(a21) * col(a21)))
    return (
        F.when((F.abs(scale - 1.0) > 0.02) & (scale > 1), "dolly_in")
        .when(F.abs(scale - 1.0) > 0.02, "dolly_out")
        .when((x > y) & (x > 2.0), "pan_horizontal")
        .when(y > 2.0, "tilt_vertical")
        .otherwise("static_shot")
    )


def clamp_list(
    c: Column | str, allowed: Sequence[str], aliases: Mapping[str, str] | None = None, most: int | None = None, is_list: bool = True
) -> Column:
    """P12. Aliases replaced, only allowed items kept, at most `most`; null counts as empty. A scalar is a list of one, '' an empty one."""
    none = F.array().cast("array<string>")
    items = F.coalesce(col(c), none) if is_list else F.when(col(c) != "", F.array(col(c))).otherwise(none)
    items = F.transform(items, lambda x: F.coalesce(_lookup(aliases or {}, x), x))
    kept = F.filter(items, lambda x: x.isin(*allowed))
    return kept if most is None else F.slice(kept, 1, most)


def clamp_choice(c: Column | str, allowed: Sequence[str], aliases: Mapping[str, str] | None = None) -> Column:
    x = F.coalesce(_lookup(aliases or {}, col(c)), col(c))
    return F.when(x.isin(*allowed), x).otherwise("")


def clamp_score(c: Column | str) -> Column:
    """A number from 0 to 1; what isn't a number is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(to_double(c), F.lit(0.0))))


def clamp_to_taxonomy(df: DataFrame, taxonomy: Mapping[str, Sequence[str]], aliases: Mapping[str, Mapping[str, str]], lists: Sequence[str],
                      choices: Sequence[str], score: str, tags: str, characteristics: str | None = None) -> DataFrame:
    """P12. The columns named are clamped in place: lists and choices to their taxonomy, tags (at most 10) to all of it, the score
    to 0..1, characteristics to 20. Text where a list belongs becomes a list of one."""
    every = sorted({v for vs in taxonomy.values() for v in vs})
    is_list = lambda c: isinstance(df.schema[c].dataType, T.ArrayType)
    new = {c: clamp_list(c, taxonomy.get(c, ()), aliases.get(c), is_list=is_list(c)) for c in lists}
    new |= {c: clamp_choice(c, taxonomy.get(c, ()), aliases.get(c)) for c in choices}
    new |= {score: clamp_score(score), tags: clamp_list(tags, every, most=10, is_list=is_list(tags))}
    if characteristics:
        new[characteristics] = F.slice(F.coalesce(F.col(characteristics), F.array().cast("array<string>")), 1, 20)
    return df.withColumns(new)


def dominant_key(counts: Column | str, order: Sequence[str]) -> Column:
    """The key with the largest count, the first of `order` among equals; null unless it is over 0."""
    entries = F.array(*[F.struct((-F.coalesce(F.element_at(col(counts), F.lit(k)), F.lit(0))).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(order)])
    return let(F.array_min(entries), lambda top: F.when(top["n"] < 0, top["k"]))


def fallback_annotation(df: DataFrame, counts: str, rhythm: str, temperature: str, contrast: str, order: Sequence[str],
                        shot: str = "medium_shot", composition: str = "rule_of_thirds") -> DataFrame:
    """P13. An annotation from measurements alone: adds camera_movements, shot_types, composition_styles, editing_rhythm, color_tone,
    lighting_style, overall_style, style_tags (sorted, at most 10) and confidence_score 0.3."""
    movement = F.array_compact(F.array(dominant_key(counts, order)))
    style = F.when(F.col(temperature) == "warm_tone", F.array(*map(F.lit, ("documentary_style", "narrative_style", "warm_mood")))).otherwise(
        F.array(F.lit("documentary_style"), F.lit("narrative_style"))
    )
    out = df.withColumns(
        {
            "camera_movements": movement, "shot_types": F.array(F.lit(shot)), "composition_styles": F.array(F.lit(composition)),
            "editing_rhythm": F.coalesce(F.col(rhythm), F.lit("moderate")), "color_tone": F.coalesce(F.col(temperature), F.lit("neutral_tone")),
            "lighting_style": F.coalesce(F.col(contrast), F.lit("medium_contrast")), "overall_style": style, "confidence_score": F.lit(0.3),
        }
    )
    tags = F.concat("shot_types", "camera_movements", "composition_styles", F.array("editing_rhythm", "color_tone", "lighting_style"), "overall_style")
    return out.withColumn("style_tags", F.slice(F.array_sort(F.array_distinct(tags)), 1, 10))


def parse_unit(c: Column | str) -> Column:
    """P14. '12 %' or '4449 MiB' -> number."""
    return to_double(F.regexp_replace(F.trim(col(c)), r"\s*(?:%|MiB)$", ""))


parse_percent = parse_mib = parse_unit


def parse_pydict(c: Column | str) -> Column:
    """P15. The text of a Python dict of numbers -> map<string,double> with lower-case keys; null if there is none."""
    body = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.replace(body, F.lit("'"), F.lit('"')), "map<string,double>")
    return F.when(F.size(parsed) > 0, F.transform_keys(parsed, lambda k, _: F.lower(k)))


def parse_namespace(c: Column | str) -> Column:
    """P15. 'Namespace(a=1, b='x')' -> map<string,string> with lower-case keys; quotes go."""
    body = F.regexp_extract(col(c), r"Namespace\((.*)\)", 1)
    keys = F.transform(F.regexp_extract_all(body, F.lit(r"(\w+)\s*=\s*([^,]+)"), F.lit(1)), lambda k: F.lower(k))
    values = F.transform(
        F.regexp_extract_all(body, F.lit(r"(\w+)\s*=\s*([^,]+)"), F.lit(2)), lambda v: F.regexp_replace(F.trim(v), "^['\"]|['\"]$", "")
    )
    return F.when(F.size(keys) > 0, F.map_from_arrays(keys, values))


def parse_duration(c: Column | str) -> Column:
    """P16. Seconds of a duration: numbers with the units h, m and s, or one to three numbers with colons between them."""
    s = F.trim(col(c))
    numbers = lambda parts: F.transform(parts, lambda x: x.try_cast("int"))
    # colons: each number is worth 60 times the next one
    clock = F.aggregate(numbers(F.split(s, ":")), F.lit(0), lambda total, n: total * 60 + n)
    # units: the first number before each of them
    first = lambda unit: F.coalesce(F.get(numbers(F.regexp_extract_all(s, F.lit(f"([0-9]+)\\s*{unit}"), F.lit(1))), 0), F.lit(0))
    units = sum((first(unit) * worth for unit, worth in (("h", 3600), ("m", 60), ("s", 1))), F.lit(0))
    return F.when(s.rlike("^([0-9]{1,2}:[0-9]{2}|[0-9]{1,3}):[0-9]{2}$|^[0-9]+$"), clock).when(s.rlike(r"[0-9]\s*[hms]"), units)


def format_duration(seconds: Column | str) -> Column:
    """P16. 'mm:ss', or 'hh:mm:ss' from an hour on; halves round to even, missing gives ''."""
    n = F.bround(to_double(seconds), 0).cast("long")
    h, m, s = F.floor(n / 3600), F.floor((n % 3600) / 60), n % 60
    return F.when(n.isNull(), "").when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def json_text(c: Column | str) -> Column:
    """P17. The outermost {...} of a model's answer, without thoughts and code fences; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def extract_json(c: Column | str, schema: str) -> Column:
    """P17. The answer's object by a schema, tried again without commas before a closing bracket; what can't be read gives an object
    whose fields are all null."""
    text = json_text(c)
    mended = F.regexp_replace(text, r",(?=\s*[]}])", "")
    read = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(read(text), read(mended), F.from_json(F.lit("{}"), schema))


def is_valid_annotation(c: Column | str, lists=("shot_types", "camera_movements", "composition_styles", "overall_style"),
                        texts=("editing_rhythm", "color_tone", "lighting_style"), score: str = "confidence_score") -> Column:
    """P18. On a struct: lists not empty, texts not blank, the score missing or a number. annotation_of finds the struct in a document."""
    c = col(c)
    ok = c.isNotNull()
    for f in lists:
        ok = ok & (F.coalesce(F.size(c[f]), F.lit(0)) > 0)
    for f in texts:
        ok = ok & (F.coalesce(F.trim(c[f]), F.lit("")) != "")
    return ok & (c[score].isNull() | to_double(c[score].cast("string")).isNotNull())


def annotation_of(df: DataFrame, path: str, wrappers: Sequence[str] = ("analysis", "video_analysis")) -> Column:
    """P18. The annotation struct of a document at a path, wrapped or bare: goes down each of the wrappers that is there."""
    for name in wrappers:
        if isinstance(type_at(df.schema, f"{path}.{name}"), T.StructType):
            path = f"{path}.{name}"
    return F.col(path)


def is_missing(c: Column | str, kind: T.DataType) -> Column:
    """P19. Null, NaN, blank text, empty list or map."""
    c = col(c)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.trim(c) == "", F.lit(True))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) == 0, F.lit(True)) | c.isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.coalesce(F.isnan(c), F.lit(False))
    return c.isNull()


def flag(condition: Column) -> Column:
    """1 or 0; null counts as 0."""
    return F.when(condition, 1).otherwise(0)


def risk_flags(rhythm: Column, tone: Column, contrast: Column, movements: Column, tags: Column, high: Sequence[str], low: Sequence[str]) -> dict[str, Column]:
    """P20. Flags by name; the tag sets are parameters. All values are compared as canonical tokens (P4), so that 'very fast' is fast."""
    rhythm, tone, contrast = map(canon_token, (rhythm, tone, contrast))
    movements, tags = (F.transform(c, canon_token) for c in (movements, tags))
    any_of = lambda names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    return {
        "is_fast": flag(rhythm.isin("fast", "very_fast")),
        "is_warm": flag(tone == "warm_tone"),
        "is_high_contrast": flag(contrast == "high_contrast"),
        "has_pan": flag(F.array_contains(movements, "pan_horizontal")),
        "high_risk": flag(any_of(high)),
        "low_risk": flag(any_of(low)),
    }


def movement_rates(count: Column | str, shots: Column | str, avg_len: Column | str) -> tuple[Column, Column]:
    """P21. (per shot, per 30 seconds) of a movement count; negative counts are 0."""
    n = F.greatest(F.coalesce(col(count).cast("double"), F.lit(0.0)), F.lit(0.0))
    shots, length = F.coalesce(col(shots).cast("double"), F.lit(0.0)), F.coalesce(col(avg_len).cast("double"), F.lit(0.0))
    return n / F.greatest(shots, F.lit(1.0)), n / F.greatest(shots * length / 30.0, F.lit(1e-6))


def wrong_flag(pred: Column | str, label: Column | str) -> Column:
    """P22."""
    return (col(pred) != col(label)).cast("int")


def composite_key(label: Column | str, value: Column | str) -> Column:
    """P22. 'label×value'; null if either is null."""
    return F.concat(col(label).cast("string"), F.lit("×"), col(value).cast("string"))


def fix_length(c: Column | str, length: int, zero=0.0) -> Column:
    """P23. struct(values, mask): every (n // length)-th item, at most `length`, or padded with zero; the mask is 1 for real items."""
    def fixed(x: Column) -> Column:
        gap = F.floor(F.size(x) / length).cast("int")
        thin = F.when(F.size(x) > length, F.slice(F.filter(x, lambda _, i: i % F.greatest(gap, F.lit(1)) == 0), 1, length)).otherwise(x)
        return let(
            thin,
            lambda t: F.struct(
                F.concat(t, F.array_repeat(F.lit(zero), length - F.size(t))).alias("values"),
                F.concat(F.array_repeat(F.lit(1), F.size(t)), F.array_repeat(F.lit(0), length - F.size(t))).alias("mask"),
            ),
        )

    return let(F.coalesce(col(c), F.array().cast("array<double>")), fixed)


def pad_segments(c: Column | str, length: int) -> Column:
    """P23. Exactly `length` segments: cut, or filled up with [-1, -1]."""
    x = F.slice(col(c), 1, length)
    return F.concat(x, F.array_repeat(F.array(F.lit(-1), F.lit(-1)), length - F.size(x)))
