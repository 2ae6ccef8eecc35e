"""Reading a yes/no answer as a class, and nearest labels for answers that say neither."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.fixed import NEGATIVE, NO, POSITIVE, YES
from tallymark.functions.text import lower_stripped


def presence_label(answer: Column, nearest: Column | None = None, mode: str = "fixed") -> Column:
    """Class of a yes/no answer by its first word; ``nearest`` (``ja`` or ``nein``) decides the rest.

    ``fixed`` turns a nearest answer into its class. ``compat`` leaves the bare answer, which reports count as
    negative.
    """
    word = lower_stripped(answer)
    if nearest is None:
        rest = F.lit(None).cast("string")
    elif mode == "compat":
        rest = nearest
    elif mode == "fixed":
        rest = F.when(nearest == YES, F.lit(POSITIVE)).when(nearest == NO, F.lit(NEGATIVE))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return (
        F.when(word.startswith(YES), F.lit(POSITIVE)).when(word.startswith(NO), F.lit(NEGATIVE)).otherwise(rest)
    )


def is_positive(label: Column) -> Column:
    """1 for the positive class, 0 for anything else, null included."""
    return F.coalesce((label == POSITIVE).cast("int"), F.lit(0))


def best_class(probabilities: Column) -> Column:
    """Index of the largest probability; the first one wins a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def decode_class(index: Column, names: dict[int, str]) -> Column:
    """Label of a class index."""
    return F.create_map(*[F.lit(part) for pair in names.items() for part in pair])[index]
