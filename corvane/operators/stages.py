"""Transform stages: a chain of column steps in which a row that fails carries its error on, counted in the same pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """``change`` makes the new text of the column it is given. A row for which ``problem`` (of the text before the change) gives a message, or
    whose new text is null, fails here."""

    name: str
    change: Callable[[Column], Column]
    problem: Callable[[Column], Column] | None = None


def run_stages(rows: DataFrame, stages: Sequence[Stage], column: str = "text", counted: Observation | None = None) -> DataFrame:
    """``rows`` with ``column`` as the stages leave it, and failed_stage and error of those that fail, whose text stays as it was before that
    stage; later stages leave them alone.

    ``counted`` gets n_rows, and failed_<name> and reached_<name> of each stage, when the result is first written: in the same pass over the data.
    """
    names = [s.name for s in stages]
    if len(set(names)) != len(names):
        raise ValueError("stages have different names")
    out = rows.withColumns({"failed_stage": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    for stage in stages:
        now = F.col(column)
        # made once, as columns of their own
        out = out.withColumns({"__message": F.when(F.col("failed_stage").isNull(), stage.problem(now)) if stage.problem else F.lit(None).cast("string"), "__new": F.when(F.col("failed_stage").isNull(), stage.change(now))})
        fails = F.col("failed_stage").isNull() & (F.col("__message").isNotNull() | F.col("__new").isNull())
        out = out.select(
            *[F.when(fails | F.col("failed_stage").isNotNull(), F.col(column)).otherwise(F.col("__new")).alias(column) if c == column else F.col(f"`{c}`") for c in rows.columns],
            F.when(fails, F.lit(stage.name)).otherwise(F.col("failed_stage")).alias("failed_stage"),
            F.when(fails, F.coalesce("__message", F.lit("no result"))).otherwise(F.col("error")).alias("error"),
        )
    if counted is None:
        return out
    place = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("failed_stage")), F.lit(len(names) + 1)) if names else F.lit(1)
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(names, 1):
        sums += [F.count_if(place == i).alias(f"failed_{name}"), F.count_if(place >= i).alias(f"reached_{name}")]
    return out.observe(counted, *sums)
