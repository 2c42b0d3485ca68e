"""The cleaning recipe: ten optional steps in a fixed order, fitted once, re-applied anywhere."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabloom.operators import clean
from tabloom.operators.clean import FittedStep
from tabloom.session import stage


@dataclass
class CleanRecipe:
    drop_high_null: bool = True
    deduplicate: bool = True
    remove_empty_rows: bool = False
    replace_placeholder_nulls: bool = False
    impute: bool = True
    strip_whitespace: bool = True
    lowercase_text: bool = False
    parse_dates: bool = True
    remove_outliers: bool = False
    snake_case: bool = False
    # settings of single steps
    null_threshold: float = 0.5
    z_threshold: float = 3.0
    subset: list[str] | None = None
    order_by: str | None = None
    approximate: bool = False
    fill_all: bool = True  # fill values of all columns, for tables with gaps elsewhere
    audit: bool = True

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "CleanRecipe":
        return cls(**json.loads(text))

    def _steps(self) -> list[tuple[bool, Callable[[DataFrame], FittedStep]]]:
        # the steps count nothing themselves; fit_transform observes them together
        return [
            (self.drop_high_null, lambda d: clean.fit_drop_high_null(d, self.null_threshold)),
            (self.deduplicate, lambda d: clean.fit_deduplicate(d, self.subset, self.order_by, audit=False)),
            (self.remove_empty_rows, lambda d: clean.fit_remove_empty_rows(d, audit=False)),
            (self.replace_placeholder_nulls, lambda d: clean.fit_replace_placeholder_nulls(d, audit=False)),
            (self.impute, lambda d: clean.fit_impute(d, self.approximate, self.fill_all)),
            (self.strip_whitespace, lambda d: clean.fit_strip_whitespace(d, audit=False)),
            (self.lowercase_text, lambda d: clean.fit_lowercase_text(d, audit=False)),
            (self.parse_dates, lambda d: clean.fit_parse_dates(d)),
            (self.remove_outliers, lambda d: clean.fit_remove_outliers(d, self.z_threshold, audit=False)),
            (self.snake_case, clean.fit_snake_case),
        ]

    def fit_transform(
        self, df: DataFrame, extra: Sequence[Callable | Transformer] = ()
    ) -> tuple["FittedRecipe", DataFrame]:
        """Fit every chosen step on the output of the ones before it.

        ``extra`` steps of the caller, functions from table to table or Spark ML
        transformers, run last. Deduplication is the one step that shuffles rows. Its result is written once, so the
        statistics of the later steps scan the needed columns of that table and do not
        repeat the shuffle. The changes of all steps are counted in one more scan, in which each step's rows are observed.
        """
        steps = []
        watched, watches = df, []
        for chosen, fit in self._steps():
            if not chosen:
                continue
            step = fit(df)
            steps.append(step)
            if step.op == "deduplicate":
                before, df = df, stage(step.transform(df))
                watched = df  # no step before this one is observed
                if self.audit:
                    step.changes["rows_removed"] = before.count() - df.count()
                continue
            if self.audit and (found := clean.changes(step, df)):
                watches.append((step, found[0], Observation()))
                watched = watched.observe(watches[-1][2], found[1].alias("n"))
            df, watched = step.transform(df), step.transform(watched)
        if watches:
            watched.agg(F.count("*")).collect()
            for step, metric, watch in watches:
                clean.note(step, metric, int(watch.get.get("n") or 0))
        for step in extra:
            steps.append(CustomStep(step))
            df = steps[-1].transform(df)
        return FittedRecipe(steps), df

    def fit(self, df: DataFrame, extra: Sequence[Callable | Transformer] = ()) -> "FittedRecipe":
        return self.fit_transform(df, extra)[0]


@dataclass
class CustomStep(FittedStep):
    """A step given as code; it is part of the recipe in memory but not of its JSON."""

    op: Callable | Transformer | str = "custom"

    def transform(self, df: DataFrame) -> DataFrame:
        return self.op.transform(df) if isinstance(self.op, Transformer) else self.op(df)

    def to_json(self) -> str:
        raise TypeError("a recipe with steps given as code cannot be written as JSON")


@dataclass
class FittedRecipe:
    steps: list[FittedStep] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def audit_log(self, spark) -> DataFrame:
        """One row per step and metric; steps that only report a reason have a null metric."""
        rows = [
            (i, step.op if isinstance(step.op, str) else "custom", metric, number, step.reason)
            for i, step in enumerate(self.steps, 1)
            for metric, number in (step.changes or {None: None}).items()
        ]
        return spark.createDataFrame(
            rows, "step int, op string, metric string, value bigint, reason string"
        )

    def to_json(self) -> str:
        return json.dumps([json.loads(step.to_json()) for step in self.steps])

    @classmethod
    def from_json(cls, text: str) -> "FittedRecipe":
        return cls([FittedStep(**d) for d in json.loads(text)])
