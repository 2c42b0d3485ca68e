"""Tables of questions answered by trained models, and generated what-if rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.intent import extract_inputs, is_prediction_question, target_column
from tabloom.operators.clean import fit_impute
from tabloom.operators.explore import MIN_SUPPORT, frequencies, input_stats
from tabloom.operators.models import CLASSIFY, CLUSTER, REGRESS
from tabloom.operators.profile import most_frequent
from tabloom.plans.ensemble import Ensemble
from tabloom.session import stage
from tabloom.types import col, is_number, present, value


def route_questions(
    questions: DataFrame, text: str, columns: Sequence[str], default: str | None = None
) -> DataFrame:
    """Questions plus ``intent`` and ``target``."""
    return questions.select(
        "*",
        is_prediction_question(col(text)).alias("intent"),
        target_column(col(text), columns, default).alias("target"),
    )


#: Condition sets that one pass over the data answers.
SHAPES_PER_PASS = 16


def conditional_answers(
    asked: DataFrame, key: str, data: DataFrame, target: str, columns: Sequence[str]
) -> DataFrame:
    """``key, matched, answer``: the mean of a number, or the most frequent value (the smallest of equals), of
    ``target`` over the rows of ``data`` that equal every value a question gives.

    ``asked`` has the key and a column for each of ``columns``, null where a question gives none. Questions
    that name the same columns share one grouping of the data, and groupings share a scan, whatever
    the number of questions: rows are aggregated before they cross the network and joined as groups. Fewer than three
    matching rows with a value give no answer; ``matched`` says how many there were. Without any value
    given, the answer is over all rows.
    """
    names = [c for c in columns if c in data.columns and c != target]
    shape = sum((F.when(col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0)).cast("long")
    shaped = asked.select(col(key).alias("_key"), shape.alias("_shape"), *[col(c).alias(f"_q{i}") for i, c in enumerate(names)])
    shapes = sorted(row[0] for row in shaped.select("_shape").distinct().collect())
    numeric = is_number(data.schema[target].dataType)
    rows = data.where(present(data, target)).select(
        F.lit(0).alias("_all"), *[col(c).alias(f"_d{i}") for i, c in enumerate(names)], value(data, target).alias("_y")
    )
    parts = []
    for at in range(0, len(shapes), SHAPES_PER_PASS):
        some = shapes[at : at + SHAPES_PER_PASS]
        sets = [["_all", *[f"_d{i}" for i in range(len(names)) if s >> i & 1]] for s in some]
        used = list(dict.fromkeys(c for s in sets for c in s))
        if numeric:
            found = _grouped(rows, sets, used).agg(
                _shape_of(used).alias("_shape"), F.count("*").alias("matched"), F.avg(F.col("_y").cast("double")).cast("string").alias("answer")
            )
        else:
            counted = _grouped(rows, [[*s, "_y"] for s in sets], [*used, "_y"]).agg(_shape_of(used).alias("_shape"), F.count("*").alias("n"))
            best = F.min(F.struct(-F.col("n"), F.col("_y").alias("y")))["y"].cast("string")
            found = counted.groupBy("_shape", *used).agg(F.sum("n").alias("matched"), best.alias("answer"))
        mine = shaped.where(F.col("_shape").isin(some))
        same = [mine["_shape"] == found["_shape"], *[mine["_q" + c[2:]].eqNullSafe(found[c]) for c in used[1:]]]
        parts.append(mine.join(found, same, "left").select("_key", mine["_shape"].alias("_shape"), "matched", "answer"))
    if not parts:
        parts.append(shaped.select("_key", "_shape", F.lit(0).alias("matched"), F.lit(None).cast("string").alias("answer")))
    out = reduce(lambda a, b: a.unionAll(b), parts)
    matched = F.coalesce("matched", F.lit(0)).cast("long")
    enough = matched >= F.when(F.col("_shape") > 0, MIN_SUPPORT).otherwise(1)
    return out.select(F.col("_key").alias(key), matched.alias("matched"), F.when(enough, F.col("answer")).alias("answer"))


def _grouped(rows: DataFrame, sets: list[list[str]], used: list[str]) -> GroupedData:
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in used])


def _shape_of(used: Sequence[str]) -> Column:
    """The data columns that a row of grouping sets was grouped by, as the bits of their places."""
    bits = [(1 - F.grouping(F.col(c)).cast("long")) * (1 << int(c[2:])) for c in used if c != "_all"]
    return sum(bits, F.lit(0)).cast("long")


def answer_questions(
    questions: DataFrame, text: str, key: str, data: DataFrame, ensemble: Ensemble, conditional: bool = False
) -> DataFrame:
    """``key, target, given, answer, source``: one row per question.

    With ``conditional``, a question about a column without a model gets that column's mean or most
    frequent value over the rows of ``data`` that equal what it gives (source ``conditional``), or over all
    rows (``data``) where it gives nothing or fewer than three rows match. Otherwise the first target's
    model answers it.

    ``model``: the question gives a value of at least one feature of the target's model, which
    answers with its prediction; the other features are filled in. ``bulk``: it asks for a
    prediction without inputs and gets the mean prediction, or the class predicted most often
    (the smallest of equals), over ``data``. ``none``: neither, and the answer is null.
    """
    fallback = ensemble.first.target
    routed = route_questions(questions.select(col(key), col(text)), text, data.columns, fallback)
    fall = F.col("target").isNull() | ~F.col("target").isin(data.columns) if conditional else F.lit(True)
    model = F.when(~F.col("target").isin(list(ensemble.targets)) & fall, fallback).otherwise(F.coalesce("target", F.lit(fallback)))
    about = routed.select(col(key).alias("_key"), col("intent").alias("_intent"), model.alias("_model"), col(text).alias("_text"))
    features = list(dict.fromkeys(c for t in ensemble.targets.values() for c in t.features.types))
    if conditional:
        features = [c for c in data.columns if is_number(data.schema[c].dataType) or isinstance(data.schema[c].dataType, T.StringType)]
    # one extraction for all models, read once by each of them
    inputs = stage(extract_inputs(about, "_text", "_key", data, features))
    parts = []
    for name, trained in ensemble.targets.items():
        own = [c for c in trained.features.types if c in inputs.columns]
        given = sum((col(c).isNotNull().cast("int") for c in own), F.lit(0))
        mine = inputs.where(F.col("_model") == name).select("_key", "_intent", given.alias("_given"), *[col(c) for c in own])
        answered = trained.predict(mine.where("_given > 0"), prefix="_answer_")
        asks = F.coalesce(F.col("_intent"), F.lit(False))
        answer = F.lit(None).cast("string")
        if not mine.where((F.col("_given") == 0) & asks).isEmpty():  # the data is scored if anyone asks
            overall = trained.predict(data.select(*[col(c) for c in trained.features.types if c in data.columns]), "_answer_")
            if trained.task == REGRESS:
                bulk = overall.agg(F.avg("_answer_prediction").cast("string"))
            else:
                bulk = frequencies(overall, "_answer_prediction", 1).select(F.col("value").cast("string"))
            answer = F.when(asks, bulk.scalar())
        rest = mine.where("_given = 0").select(
            "_key",
            "_given",
            answer.alias("answer"),
            F.when(asks, "bulk").otherwise("none").alias("source"),
        )
        told = answered.select(
            "_key", "_given", F.col("_answer_prediction").cast("string").alias("answer"), F.lit("model").alias("source")
        )
        parts.append(
            told.unionByName(rest).select(
                col("_key").alias(key), F.lit(name).alias("target"), F.col("_given").alias("given"), "answer", "source"
            )
        )
    others = [c for c in data.columns if c not in ensemble.targets] if conditional else []
    for name in [r[0] for r in inputs.where(F.col("_model").isin(others)).select("_model").distinct().collect()] if others else []:
        own = [c for c in features if c != name]
        given = sum((col(c).isNotNull().cast("int") for c in own), F.lit(0))
        mine = inputs.where(F.col("_model") == name).select("_key", given.alias("_given"), *[col(c) for c in own])
        found = conditional_answers(mine, "_key", data, name, own)
        nothing = mine.limit(1).select("_key", *[F.lit(None).cast(data.schema[c].dataType).alias(c) for c in own])
        overall = conditional_answers(nothing, "_key", data, name, own).select("answer").scalar()
        told = (F.col("_given") > 0) & F.col("answer").isNotNull()
        parts.append(
            mine.select("_key", "_given").join(found, "_key").select(
                col("_key").alias(key),
                F.lit(name).alias("target"),
                F.col("_given").alias("given"),
                F.when(told, F.col("answer")).otherwise(overall).alias("answer"),
                F.when(told, "conditional").otherwise("data").alias("source"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def what_if_grid(
    df: DataFrame, features: Sequence[str], vary: Sequence[str], values: int = 3
) -> DataFrame:
    """One row per combination of values of the varied features, the others held typical.

    A varied number takes its minimum, midpoint and maximum, a varied category its most
    frequent values; the others take median or mode. The grid has at most
    ``max(3, values) ** len(vary)`` rows, whatever the size of the table; beyond
    ``MAX_GRID`` that is an error.
    """
    if max(3, values) ** len(vary) > MAX_GRID:
        raise ValueError(f"the grid would have more than {MAX_GRID:,} rows: vary fewer features")
    fills = fit_impute(df.select(*[col(c) for c in features]), fill_all=True).params
    typical = {**fills["medians"], **fills["modes"]}
    ranges = {r["column"]: r for r in input_stats(df, list(vary), approximate=True).collect()}
    out = df.sparkSession.range(1).select()
    for c in features:
        dtype = "double" if is_number(df.schema[c].dataType) else df.schema[c].dataType
        if c not in vary:
            out = out.withColumn(c, F.lit(typical[c]).cast(dtype))
            continue
        if ranges[c].kind == "numeric":
            lo, hi = ranges[c]["min"], ranges[c]["max"]
            points = [] if lo is None else list(dict.fromkeys([lo, (lo + hi) / 2, hi]))
        else:
            points = [r.value for r in frequencies(df, c, values).collect()]
        points = points or [None]
        out = out.withColumn(c, F.explode(F.array(*[F.lit(p).cast(dtype) for p in points])))
    return out


MAX_GRID = 1_000_000
VERBS = {CLASSIFY: "Predict", REGRESS: "Estimate", CLUSTER: "Predict"}


def suggested_questions(
    df: DataFrame, features: Sequence[str], label: str | None, task: str, limit: int | None = None
) -> list[str]:
    """Distinct questions about the target: every number at its maximum and at its median, every
    category at its most frequent value, and neighbouring numbers together at their maxima.

    All features are asked about, in their order; ``limit`` keeps the first questions. Columns
    without values are left out.
    """
    known = [c for c in features if c in df.columns]
    numeric = [c for c in known if is_number(df.schema[c].dataType)]
    categories = [c for c in known if c not in numeric]
    stats = {r["column"]: r for r in input_stats(df, numeric).collect()} if numeric else {}
    high = [(c, round(stats[c]["max"], 4)) for c in numeric if stats[c]["max"] is not None]
    middle = [(c, round(stats[c]["median"], 4)) for c, _ in high]
    frequent = most_frequent(df, categories) if categories else {}
    usual = [(c, frequent[c].value) for c in categories if frequent[c].value is not None]
    cases = [[x] for x in (*high, *middle, *usual)] + [list(pair) for pair in zip(high, high[1:])]
    asked = [
        f"{VERBS[task]} {label or 'the cluster'} for " + " and ".join(f"{c} = {x}" for c, x in case) for case in cases
    ]
    return list(dict.fromkeys(asked))[:limit]
