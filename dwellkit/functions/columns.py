"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def ratio_or_count(n0: Column, n1: Column) -> Column:
    """n0 / n1, or n0 itself where n1 is 0."""
    return F.when(n1 > 0, n0.cast("double") / n1.cast("double")).otherwise(n0.cast("double"))


def plogp(p: Column, base: float | None = 2) -> Column:
    """-p log p, 0 at p = 0; natural log where base is None."""
    log = F.log2(p) if base == 2 else F.ln(p)
    return F.when(p > 0, -p * log).otherwise(F.lit(0.0))


def argmax(values: Column) -> Column:
    """Zero-based position of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_or_null(probs: Column, threshold: float) -> Column:
    """The argmax class where its probability reaches the threshold, else NULL."""
    return F.when(F.array_max(probs) >= F.lit(float(threshold)), argmax(probs))


def class_name(label: Column, names: Sequence[str]) -> Column:
    """Name of a class index; NULL for NULL or an index outside the list."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.get(listed, label)


def one_hot(label: Column, n_classes: int) -> Column:
    """k-vector with 1.0 at the label."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda i: F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def above(prob: Column, threshold: float | Column) -> Column:
    """1 where the probability is strictly above the threshold, else 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (prob > limit).cast("int")


def binary_state(state: Column) -> Column:
    """Any open level counts as 1."""
    return (state > 0).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def lookup(index: Column, values: Sequence) -> Column:
    """values[index] for a small fixed list; NULL outside it."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def short_name(name: Column) -> Column:
    """Last character of a class name (the letter used in file names)."""
    return F.lower(F.substring(name, -1, 1))


def fixed(x: Column, digits: int = 4) -> Column:
    """Fixed-point text of a number without thousands separators."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def pad(states: Column, length: int, keep: str = "head", value: float = -1.0) -> Column:
    """Exactly ``length`` floats: longer lists keep their head or tail, shorter ones
    get ``value`` appended."""
    size = F.size(states)
    if keep == "head":
        kept = F.slice(states, 1, length)
    elif keep == "tail":
        kept = F.slice(states, F.greatest(size - length, F.lit(0)) + 1, F.lit(length))
    else:
        raise ValueError("keep must be 'head' or 'tail'")
    fill = F.array_repeat(F.lit(float(value)).cast("float"), F.greatest(F.lit(0), F.lit(length) - size))
    return F.concat(F.transform(kept, lambda s: s.cast("float")), fill)
