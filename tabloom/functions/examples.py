"""Rows as instruction or chat training examples in JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.types import col, is_float


def _double_text(c: Column) -> Column:
    """A double in plain decimals between 1e-4 and 1e16, else with a signed exponent."""
    x = c.cast("double")
    plain = x.cast("string")
    size = F.abs(x)
    fixed = F.when(size >= 1e7, x.cast("decimal(38,10)").cast("string")).otherwise(
        x.cast("decimal(38,22)").cast("string")
    )
    fixed = F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    exponent = F.substring_index(plain, "E", -1).try_cast("int")
    digits = F.abs(exponent).cast("string")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )
    return (
        F.when(~plain.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e16), fixed)
        .otherwise(scientific)
    )


def cell_text(df: DataFrame, name: str, null_text: str = "") -> Column:
    """One cell as text: numbers in plain decimals, True/False, times to the microsecond."""
    c, dtype = col(name), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        text = c
    elif is_float(dtype):
        text = F.when(F.isnan(c), None).otherwise(_double_text(c))
    elif isinstance(dtype, T.BooleanType):
        text = F.initcap(c.cast("string"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(null_text))


def concat_text(
    df: DataFrame, cols: Sequence[str], sep: str = "\n", null_text: str = ""
) -> Column:
    """The named cells joined by ``sep``; absent columns are skipped, no columns give ''."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return F.lit("")
    return F.concat_ws(sep, *[cell_text(df, c, null_text) for c in present])


def instruction_example(
    df: DataFrame,
    text_cols: Sequence[str],
    label_cols: Sequence[str] | None = None,
    input_cols: Sequence[str] | None = None,
    null_text: str = "",
) -> Column:
    """struct<instruction, [input,] output>; output is '' without labels."""
    fields = [concat_text(df, text_cols, null_text=null_text).alias("instruction")]
    if input_cols:
        fields.append(concat_text(df, input_cols, null_text=null_text).alias("input"))
    fields.append(concat_text(df, label_cols or [], null_text=null_text).alias("output"))
    return F.struct(*fields)


def chat_example(
    df: DataFrame,
    text_cols: Sequence[str],
    label_cols: Sequence[str] | None = None,
    system_prompt: str | None = None,
    null_text: str = "",
) -> Column:
    """struct<messages>; the assistant turn exists only when there are labels."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = [turn("user", concat_text(df, text_cols, null_text=null_text))]
    if system_prompt is not None:
        turns.insert(0, turn("system", F.lit(system_prompt)))
    if label_cols:
        turns.append(turn("assistant", concat_text(df, label_cols, null_text=null_text)))
    return F.struct(F.array(*turns).alias("messages"))


def _as_json(example: Column) -> Column:
    return F.to_json(example, {"ignoreNullFields": "false"})


def to_instruction_jsonl(
    df: DataFrame, text_cols, label_cols=None, keep: Sequence[str] = (), **options
) -> DataFrame:
    """One JSON line per row in column ``value``; ``keep`` carries columns such as the key."""
    line = _as_json(instruction_example(df, text_cols, label_cols, **options))
    return df.select(*[col(k) for k in keep], line.alias("value"))


def to_chat_jsonl(
    df: DataFrame, text_cols, label_cols=None, keep: Sequence[str] = (), **options
) -> DataFrame:
    line = _as_json(chat_example(df, text_cols, label_cols, **options))
    return df.select(*[col(k) for k in keep], line.alias("value"))


def format_examples(
    df: DataFrame, text_cols, label_cols=None, fmt: str = "instruction", **options
) -> dict[str, DataFrame]:
    """``fmt`` is 'instruction', 'chat' or 'both'."""
    if fmt not in ("instruction", "chat", "both"):
        raise ValueError(f"unknown format: {fmt}")
    writers = {"instruction": to_instruction_jsonl, "chat": to_chat_jsonl}
    return {
        name: write(df, text_cols, label_cols, **options)
        for name, write in writers.items()
        if fmt in (name, "both")
    }
