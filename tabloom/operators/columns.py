"""Projections and column resolution: roles, drops, renames, duplicate names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame

from tabloom.functions.text import snake_case
from tabloom.types import Roles, col


def apply_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Drop the columns marked for dropping; names that do not exist are ignored."""
    return df.drop(*[c for c in roles.drop if c in df.columns])


def select_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Only the feature and label columns, features first."""
    names = list(dict.fromkeys([*roles.features, *roles.labels]))
    return df.select(*[col(c) for c in names if c in df.columns])


def drop_duplicate_names(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with one name."""
    first = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    if len(first) == len(df.columns):
        return df
    unique = [f"_{i}" for i in range(len(df.columns))]
    kept = [(f"_{i}", name) for i, name in enumerate(df.columns) if first[name] == i]
    return df.toDF(*unique).select(*[col(u).alias(name) for u, name in kept])


def rename_snake_case(df: DataFrame) -> DataFrame:
    """Snake-case names; of names that become equal the first column stays."""
    return drop_duplicate_names(df.toDF(*[snake_case(c) for c in df.columns]))


def reconcile(names: Sequence[str], before: Sequence[str], after: Sequence[str]) -> list[str]:
    """Names as they are called after cleaning; columns that were dropped fall out."""
    found = []
    for name in names:
        if name in after:
            found.append(name)
        elif name in before and snake_case(name) in after:
            found.append(snake_case(name))
    return found


def reconcile_roles(roles: Roles, before: Sequence[str], after: Sequence[str]) -> Roles:
    return replace(
        roles,
        features=reconcile(roles.features, before, after),
        labels=reconcile(roles.labels, before, after),
    )


def missing_roles(roles: Roles, columns: Sequence[str]) -> dict[str, list[str]]:
    """Role names that no current column has; empty when the roles are valid."""
    gaps = {
        role: [c for c in getattr(roles, role) if c not in columns] for role in ("features", "labels")
    }
    return {role: names for role, names in gaps.items() if names}


def validate_roles(roles: Roles, columns: Sequence[str]) -> Roles:
    """Roles that can be used as they are; a role with an unknown name is cleared."""
    gaps = missing_roles(roles, columns)
    return replace(roles, **{role: [] for role in gaps})


def resolve_features(roles: Roles, columns: Sequence[str]) -> list[str]:
    """Features that exist and are not labels, else all other columns; labels only if nothing else is there."""
    features = [c for c in roles.features if c in columns and c not in roles.labels]
    others = [c for c in columns if c not in roles.labels]
    return features or others or [c for c in roles.features if c in columns]


def resolve_targets(roles: Roles, columns: Sequence[str]) -> list[str]:
    """Every label that exists; none means clustering."""
    return [c for c in roles.labels if c in columns]
