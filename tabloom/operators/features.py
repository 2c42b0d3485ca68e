"""Feature preparation shared by all models: fill, standardise, one-hot, assemble."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA,
    FeatureHasher,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.clean import fit_impute
from tabloom.types import col, is_float, is_number, value

VECTOR = "_features"
MAX_CATEGORIES = 1000
HASHED_SLOTS = 4096


@dataclass
class FeatureModel:
    """A fitted feature ``PipelineModel`` and what is needed to feed and explain it."""

    model: PipelineModel
    types: dict[str, str]  # feature -> type it was trained with
    fills: dict[str, float | str | None]
    slots: list[str] = field(default_factory=list)  # source column of each vector slot

    def complete(self, df: DataFrame) -> DataFrame:
        """Absent features become null columns, which the model then fills."""
        absent = [c for c in self.types if c not in df.columns]
        return df.select("*", *[F.lit(None).cast(self.types[c]).alias(c) for c in absent])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.complete(df))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(literal: str) -> str:
    return "'" + literal.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(df: DataFrame, name: str) -> str:
    x = f"CAST({_quoted(name)} AS DOUBLE)"
    return f"NULLIF({x}, DOUBLE('NaN'))" if is_float(df.schema[name].dataType) else x


def fit_features(
    df: DataFrame,
    features: Sequence[str],
    max_categories: int = MAX_CATEGORIES,
    approximate: bool = False,
    encoding: str = "onehot",
) -> FeatureModel:
    """Numbers: median fill, then zero mean and unit (population) deviation. Text: mode fill,
    then one-hot, where categories not seen here are all zeros. Other types are left out.

    One-hot keeps one value list per column on the driver, so a text column with more than
    ``max_categories`` values is an error; ``encoding="hash"`` hashes all text columns into a
    fixed number of slots, where values can share one.
    """
    numeric = [c for c in features if is_number(df.schema[c].dataType)]
    text = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    if not numeric and not text:
        raise ValueError("no numeric or text feature columns")
    used = df.select(*[col(c) for c in [*numeric, *text]])
    fitted = fit_impute(used, approximate=approximate, fill_all=True).params
    medians = {c: 0.0 if m is None else m for c, m in fitted["medians"].items()}
    modes = {c: m or "" for c, m in fitted["modes"].items()}

    filled = {c: F.coalesce(value(used, c).cast("double"), F.lit(medians[c])) for c in numeric}
    stats = used.agg(
        F.count("*"),
        *[F.struct(F.avg(x), F.stddev_pop(x)) for x in filled.values()],
        *[F.approx_count_distinct(col(c)) for c in text],
    ).first()
    spread = dict(zip(numeric, stats[1 : 1 + len(numeric)]))
    sizes = dict(zip(text, stats[1 + len(numeric) :]))
    if encoding not in ("onehot", "hash"):
        raise ValueError("encoding is onehot or hash")
    onehot, hashed = (text, []) if encoding == "onehot" else ([], text)
    if near := [c for c in onehot if sizes[c] > max_categories // 2]:  # the estimate doesn't decide
        for c, n in zip(near, used.agg(*[F.count_distinct(col(c)) for c in near]).first()):
            if n > max_categories:
                raise ValueError(f"{c} has {n} values: raise max_categories={max_categories} or take encoding='hash'")

    columns, names = [], {}
    for i, c in enumerate([*numeric, *text]):
        names[c] = f"_in{i}"
        if c in spread:
            mean, std = (spread[c][0] or 0.0), (spread[c][1] or 1.0)
            filled_sql = f"COALESCE({_number(used, c)}, {medians[c]!r}D)"
            expr = f"({filled_sql} - {mean!r}D) / {std!r}D"
        else:
            # the sign keeps the empty string usable as a category name
            expr = f"CONCAT('=', COALESCE({_quoted(c)}, {_text(modes[c])}))"
        columns.append(f"{expr} AS {names[c]}")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
    vectors = [names[c] for c in numeric]
    if onehot:
        indexed, encoded = [f"{names[c]}_i" for c in onehot], [f"{names[c]}_v" for c in onehot]
        stages += [
            StringIndexer(
                inputCols=[names[c] for c in onehot],
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            # the last index stands for unseen values and is the one that dropLast drops
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
        vectors += encoded
    if hashed:
        stages.append(
            FeatureHasher(
                inputCols=[names[c] for c in hashed],
                outputCol="_hashed",
                numFeatures=HASHED_SLOTS,
                categoricalCols=[names[c] for c in hashed],
            )
        )
        vectors.append("_hashed")
    stages.append(VectorAssembler(inputCols=vectors, outputCol=VECTOR))
    model = Pipeline(stages=stages).fit(used)

    slots = list(numeric)
    if onehot:
        indexer = model.stages[1]
        for c, labels in zip(onehot, indexer.labelsArray):
            slots += [c] * len(labels)
    if hashed:
        slots += ["+".join(hashed)] * HASHED_SLOTS
    types = {c: df.schema[c].dataType.simpleString() for c in [*numeric, *text]}
    return FeatureModel(model, types, {**medians, **modes}, slots)


def standardised(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature vectors as one array column ``vector``, beside the ``keep`` columns."""
    fitted = fit_features(df, features)
    return fitted.transform(df).select(
        *[col(k) for k in keep], vector_to_array(F.col(VECTOR)).alias("vector")
    )


def principal_components(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), k: int = 2
) -> DataFrame:
    """``keep`` columns and PC1…PCk of the centred numeric features (signs are arbitrary).

    Missing cells take the column median.
    """
    numeric = [c for c in features if is_number(df.schema[c].dataType)]
    filled = fit_impute(df.select(*[col(c) for c in numeric])).transform(df)
    cast = filled.select(
        *[col(c) for c in keep],
        *[col(c).cast("double").alias(f"_in{i}") for i, c in enumerate(numeric)],
    )
    stages = [
        VectorAssembler(inputCols=[f"_in{i}" for i in range(len(numeric))], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol="_pc"),
    ]
    out = Pipeline(stages=stages).fit(cast).transform(cast)
    pc = vector_to_array(F.col("_pc"))
    return out.select(*[col(c) for c in keep], *[pc[i].alias(f"PC{i + 1}") for i in range(k)])
