"""What a free-text question asks for: intent, target column, feature values."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import stage
from tabloom.types import col, is_number

# A question that contains one of these asks for a prediction.
PREDICTION_WORDS = [
    "predict", "forecast", "future", "projection", "will be", "would be", "what if", "estimate",
    "expected", "next", "upcoming", "trend", "outlook", "guess", "what would", "what will", "how much",
]

# Ways to name the target; {c} stands for the column name.
TARGET_PATTERNS = [
    r"predict\s+{c}",
    r"forecast\s+{c}",
    r"what (?:is|will be|would be)\s+(?:the\s+)?{c}",
    r"{c}\s+(?:of|for|when|if)",
    r"estimate\s+{c}",
]

# Ways to give a number for a feature, in order of preference.
NUMBER_PATTERNS = [
    r"{c}\s*[=:]\s*([\d\.]+)",
    r"{c}\s+is\s+([\d\.]+)",
    r"{c}\s+(?:of|at)\s+([\d\.]+)",
    r"([\d\.]+)\s+{c}",
]

# What may stand between a feature and its value, and between a value and its feature.
VALUE_AFTER = [
    r"{c}\s*(?:is|=|:|of|as)\s*",
    r"{c}\s*",
    r"{c}\s+(?:for|with|and|where|having)\s+",
]
VALUE_BEFORE = r"\s+(?:of|in|for|at|as)\s+{c}"
MIN_VALUE_LENGTH = 2


def is_prediction_question(text: Column) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w) for w in PREDICTION_WORDS))


def target_column(text: Column, columns: Sequence[str], default: str | None = None) -> Column:
    """The first column that the question names as its target."""
    question = F.lower(text)
    found = [
        F.when(
            question.rlike("|".join(p.format(c=re.escape(c.lower())) for p in TARGET_PATTERNS)), F.lit(c)
        )
        for c in columns
    ]
    return F.coalesce(*found, F.lit(default).cast("string"))


def _spellings(name: str) -> str:
    """The column name as it may be written in a sentence, as one pattern."""
    words = [re.escape(w) for w in re.split(r"[_ ]", name.lower())]
    return "(?:" + "[_ ]?".join(words) + ")"


def number_value(text: Column, feature: str) -> Column:
    """The number a question gives for a feature, null if none."""
    question, name = F.lower(text), _spellings(feature)
    found = [
        F.nullif(F.regexp_extract(question, p.format(c=name), 1), F.lit("")).try_cast("double")
        for p in NUMBER_PATTERNS
    ]
    return F.coalesce(*found)


def category_values(
    questions: DataFrame, text: str, key: str, data: DataFrame, features: Sequence[str]
) -> DataFrame:
    """``key`` and one column per categorical feature: the longest value of that feature
    that the question names next to it. Questions that name none have no row.

    The distinct values stay a distributed table. Each mention of a feature yields the
    substrings beside it, of the lengths that occur among the values, and these are matched
    by an equi-join.
    """
    cells = [F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(features)]
    # written once: read for its lengths and again by the join, which its true size decides
    values = stage(
        data.select(F.inline(F.array(*cells)))
        .where(F.length("v") >= MIN_VALUE_LENGTH)
        .distinct()
        .withColumn("piece", F.lower("v"))
    )
    sizes: dict[int, list[int]] = {}
    for row in values.select("i", F.length("piece").alias("size")).distinct().collect():
        sizes.setdefault(row.i, []).append(row.size)
    question = F.lower(col(text))
    pieces = []
    for i, lengths in sorted(sizes.items()):
        name = _spellings(features[i])
        lens = F.array(*[F.lit(n) for n in sorted(lengths)])

        def cut(side, lens=lens):
            fits = lambda rest: F.filter(lens, lambda n: n <= F.length(rest))
            return lambda rest: F.transform(fits(rest), lambda n: side(rest, n))

        after = F.concat(
            *[
                F.regexp_extract_all(question, F.lit(f"(?s)(?={p.format(c=name)}(.*))"), F.lit(1))
                for p in VALUE_AFTER
            ]
        )
        split = F.split(question, VALUE_BEFORE.format(c=name))
        before = F.slice(split, F.lit(1), F.size(split) - 1)
        beside = F.concat(
            F.flatten(F.transform(after, cut(lambda rest, n: F.substring(rest, F.lit(1), n)))),
            F.flatten(F.transform(before, cut(lambda rest, n: F.right(rest, n)))),
        )
        pieces.append(F.struct(F.lit(i).alias("i"), F.array_distinct(beside).alias("pieces")))
    if not pieces:
        empty = questions.select(col(key)).limit(0)
        return empty.select(col(key), *[F.lit(None).cast("string").alias(c) for c in features])
    candidates = (
        questions.where(col(text).isNotNull())
        .select(col(key).alias("k"), F.inline(F.array(*pieces)))
        .select("k", "i", F.explode("pieces").alias("piece"))
    )
    # longest value first, then the smallest, so that equal spellings give one answer
    best = [
        F.min(F.when(F.col("i") == i, F.struct(-F.length("v"), F.col("v").alias("v"))))["v"].alias(c)
        for i, c in enumerate(features)
    ]
    return candidates.join(values, ["i", "piece"]).groupBy(F.col("k").alias(key)).agg(*best)


def extract_inputs(
    questions: DataFrame, text: str, key: str, data: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Questions plus one typed column per feature (null where not given) and ``given``,
    the number of features a question gives a value for."""
    present = [c for c in features if c in data.columns]
    numeric = [c for c in present if is_number(data.schema[c].dataType)]
    other = [c for c in present if c not in numeric]
    out = questions
    if other:
        out = out.join(category_values(questions, text, key, data, other), key, "left")
    types = {c: data.schema[c].dataType for c in other}
    inputs = [
        number_value(col(text), c).alias(c) if c in numeric else col(c).cast(types[c]).alias(c)
        for c in present
    ]
    out = out.select(*[col(c) for c in questions.columns], *inputs)
    given = sum((col(c).isNotNull().cast("int") for c in present), F.lit(0))
    return out.withColumn("given", given)
