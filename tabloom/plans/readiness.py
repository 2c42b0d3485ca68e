"""Is this table ready to train on, for which task, and what speaks against it?

One grouped count gives the facts; a table of rules turns them into findings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.models import CLASSIFY, CLUSTER, REGRESS
from tabloom.plans.ensemble import CLASSES_BELOW
from tabloom.types import Roles, col, is_number, present


@dataclass(frozen=True)
class Facts:
    """What the rules look at: columns by kind, and counts of rows and label values."""

    numeric: list[str]
    categorical: list[str]
    rows: int
    label: str | None = None
    label_wanted: bool = False
    text_label: bool = False
    classes: int = 0
    labelled: int = 0
    largest: int = 0
    commonest: object = None

    @property
    def task(self) -> str:
        if self.label is None:
            return CLUSTER
        return CLASSIFY if self.text_label or self.classes < CLASSES_BELOW else REGRESS

    @property
    def share(self) -> float | None:
        return self.largest / self.labelled if self.labelled else None


@dataclass(frozen=True)
class Rule:
    code: str
    holds: Callable[[Facts], object]
    detail: Callable[[Facts], str]
    blocks: bool = False


# The thresholds and the names of the recommended kinds of model.
RULES = (
    Rule("features_missing", lambda t: not (t.numeric or t.categorical), lambda t: "name a feature that the table has", True),
    Rule("rows_missing", lambda t: t.rows == 0, lambda t: "there is nothing to learn from", True),
    Rule("label_missing", lambda t: t.label_wanted and t.label is None, lambda t: "the table has none of the labels", True),
    Rule("numbers_missing", lambda t: t.categorical and not t.numeric, lambda t: "every feature is a category"),
    Rule("rows_few", lambda t: not t.label_wanted and 0 < t.rows < 5, lambda t: f"{t.rows} rows make no groups"),
    Rule("labels_few", lambda t: t.label and t.rows and t.labelled < 10, lambda t: f"{t.labelled} rows carry a label"),
    Rule("classes_many", lambda t: t.label and t.task == CLASSIFY and t.classes > 10, lambda t: f"{t.classes} classes; merge small ones"),
    Rule("classes_rare", lambda t: t.label and t.task == CLASSIFY and 2 * t.classes > t.labelled, lambda t: f"{t.classes} classes share {t.labelled} rows"),
    Rule("class_dominates", lambda t: t.task == CLASSIFY and (t.share or 0) > 0.8, lambda t: f"{t.commonest}: {t.share:.0%} of all labels"),
    Rule("values_few", lambda t: t.task == REGRESS and t.classes < 30 and t.labelled > 100, lambda t: f"{t.classes} distinct numbers could be classes"),
)


def recommended(t: Facts) -> str | None:
    if t.task != CLASSIFY:
        return t.task
    if t.classes > 10:
        return None
    return "binary_classification" if t.classes == 2 else f"multiclass_classification_{t.classes}_classes"


@dataclass
class Readiness:
    facts: Facts
    findings: list[tuple[str, str]] = field(default_factory=list)  # (code, detail)
    ready: bool = True
    #: ``value, n, share`` of every label value, as a lazy table.
    label_distribution: DataFrame | None = None

    @property
    def task_type(self) -> str:
        return self.facts.task

    @property
    def codes(self) -> list[str]:
        return [code for code, _ in self.findings]

    @property
    def recommendation(self) -> str | None:
        return recommended(self.facts) if self.ready else None

    def warnings_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.findings, "code string, detail string")

    def to_frame(self, spark: SparkSession) -> DataFrame:
        t = self.facts
        values = {
            "ready boolean": self.ready,
            "task_type string": self.task_type,
            "recommendation string": self.recommendation,
            "warnings array<string>": self.codes,
            "row_count bigint": t.rows,
            "feature_count int": len(t.numeric) + len(t.categorical),
            "numeric_features array<string>": t.numeric,
            "categorical_features array<string>": t.categorical,
            "label_cardinality bigint": t.classes if t.label else None,
            "label_samples bigint": t.labelled if t.label else None,
            "majority_share double": t.share,
        }
        return spark.createDataFrame([tuple(values.values())], ", ".join(values))


def gather_facts(df: DataFrame, roles: Roles) -> Facts:
    """One job: rows per label value, summed up. The label is the first one that exists."""
    features = [c for c in roles.features if c in df.columns]
    numeric = [c for c in features if is_number(df.schema[c].dataType)]
    label = next((c for c in roles.labels if c in df.columns), None)
    key = F.when(present(df, label), col(label)) if label else F.lit(None).cast("string")
    groups = df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    s = groups.agg(
        F.sum("n").alias("rows"),
        F.count("value").alias("classes"),
        F.sum(known).alias("labelled"),
        F.max(known).alias("largest"),
        F.min_by("value", F.struct(-known, "value")).alias("commonest"),
    ).first()
    return Facts(
        numeric,
        [c for c in features if c not in numeric],
        s.rows or 0,
        label,
        bool(roles.labels),
        label is not None and isinstance(df.schema[label].dataType, (T.StringType, T.BooleanType)),
        s.classes,
        s.labelled or 0,
        s.largest or 0,
        s.commonest,
    )


def assess(df: DataFrame, roles: Roles) -> Readiness:
    """Facts of the table and the findings of all rules; one that blocks makes it not ready."""
    facts = gather_facts(df, roles)
    hits = [r for r in RULES if r.holds(facts)]
    shares = None
    if facts.label:
        counts = df.where(present(df, facts.label)).groupBy(col(facts.label).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        shares = counts.withColumn("share", F.col("n") / facts.labelled) if facts.labelled else counts
    return Readiness(facts, [(r.code, r.detail(facts)) for r in hits], not any(r.blocks for r in hits), shares)
