"""Tables derived from funnels. Inputs are final results of a few rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    iso_date,
    minute_stamp,
    pct,
    percent_text,
    share,
    short_date,
    signed_percent_text,
    thousands,
)
from ..functions.time import Moment, timestamp_literal
from ..sources import metric_columns, rename_metrics

TOTAL = "TOTAL"


def stage_dropoff(funnel: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per step of a one-row funnel: entrants, drop to the next column, drop in % of the whole cohort.

    ``order`` starts with the cohort size. The last line, TOTAL, runs from the first column to the last.
    """
    total = F.coalesce(F.col(order[0]), F.lit(0))

    def line(step: int, stage: str, enter: str, leave: str):
        entered = F.coalesce(F.col(enter), F.lit(0))
        drop = entered - F.coalesce(F.col(leave), F.lit(0))
        return F.struct(
            F.lit(step).alias("step"),
            F.lit(stage).alias("stage"),
            entered.cast("bigint").alias("enter"),
            drop.cast("bigint").alias("drop_n"),
            share(drop, total).alias("drop_pct"),
        )

    steps = [line(i, order[i], order[i - 1], order[i]) for i in range(1, len(order))]
    return funnel.select(F.inline(F.array(*steps, line(len(order), TOTAL, order[0], order[-1]))))


def cohort_delta(dropoff: DataFrame, reference_dropoff: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """Difference of drop percentages from a reference cohort, step by step.

    Both sides come from ``stage_dropoff`` and have one row per step, which bounds the broadcast.
    """
    reference = reference_dropoff.select("step", F.col("drop_pct").alias("reference_pct"))
    delta = F.col("drop_pct") - F.col("reference_pct")
    return (
        dropoff.join(F.broadcast(reference), "step")
        .select("step", "stage", delta.alias("delta"))
        .withColumn(
            "label",
            F.when(F.abs("delta") < tolerance, "neutral").when(F.col("delta") > 0, "bad").otherwise("good"),
        )
    )


def headline_rates(funnel: DataFrame, total: str, done: str) -> DataFrame:
    """Completed and lost shares of a one-row funnel."""
    all_of, finished = F.coalesce(F.col(total), F.lit(0)), F.coalesce(F.col(done), F.lit(0))
    return funnel.select(
        pct(finished, all_of).alias("done_pct"),
        (all_of - finished).cast("bigint").alias("lost"),
        pct(all_of - finished, all_of).alias("lost_pct"),
    )


def variant_ranking(variant_funnel: DataFrame, entry: str, paid: str, allowed: Sequence[str]) -> DataFrame:
    """Variants by conversion, best first, ties by name. Only allowed variants, so a few rows, are ranked."""
    ratio = F.col(paid) / F.greatest(F.col(entry), F.lit(1))
    order = Window.orderBy(F.desc(ratio), "variant")
    return variant_funnel.filter(F.col("variant").isin(*allowed)).select(
        F.row_number().over(order).alias("rank"),
        "variant",
        F.col(entry),
        F.col(paid),
        pct(F.col(paid), F.col(entry)).alias("conv_pct"),
    )


def report_lines(dropoff: DataFrame, delta: DataFrame) -> DataFrame:
    """Drop-off table as display text; both inputs have one row per step."""
    mark = (
        F.when(F.col("label") == "neutral", F.lit("≈"))
        .when(F.col("label") == "bad", F.concat(F.lit("▲ "), signed_percent_text(F.col("delta"))))
        .otherwise(F.concat(F.lit("▼ "), percent_text(F.col("delta"))))
    )
    return dropoff.join(F.broadcast(delta.select("step", "delta", "label")), "step").select(
        "step",
        "stage",
        thousands(F.col("enter")).alias("enter_text"),
        F.col("drop_n").cast("string").alias("drop_text"),
        percent_text(F.col("drop_pct")).alias("pct_text"),
        mark.alias("delta_text"),
    )


def metrics_snapshot(
    post_funnel: DataFrame,
    new_release: DataFrame | None,
    variants: DataFrame | None,
    as_of: Moment,
    post_names: Mapping[str, str],
    release_names: Mapping[str, str],
    variant_names: Mapping[str, str],
    allowed: Sequence[str],
    stamp_suffix: str = "",
) -> DataFrame:
    """One row holding the metrics record; ``*_names`` map record keys to funnel columns.

    ``stamp_suffix`` follows the time of the refresh, such as `` UTC``.

    The parts are one-row frames, stacked and folded into one row, so nothing is joined.
    """
    parts = {
        "post_end_date": post_funnel.select(iso_date(F.col("post_end_date")).alias("part")),
        "post_funnel": rename_metrics(post_funnel, post_names).select(F.struct("*").alias("part")),
    }
    if new_release is not None:
        parts["new_release"] = rename_metrics(new_release, release_names).select(F.struct("*").alias("part"))
    if variants is not None:
        kept = variants.filter(F.col("variant").isin(*allowed))
        metrics = F.struct(*metric_columns(variants, variant_names)).alias("metrics")
        entries = F.array_sort(F.collect_list(F.struct("variant", metrics)))
        parts["variants"] = kept.agg(F.map_from_entries(entries).alias("part"))
    stacked = None
    for name, part in parts.items():
        row = part.select(
            *[
                (F.col("part") if other == name else F.lit(None).cast(parts[other].schema["part"].dataType)).alias(other)
                for other in parts
            ]
        )
        stacked = row if stacked is None else stacked.unionByName(row)
    stamp = F.concat(minute_stamp(timestamp_literal(as_of)), F.lit(stamp_suffix))
    return stacked.agg(*[F.first(name, ignorenulls=True).alias(name) for name in parts]).select(
        stamp.alias("refreshed_at"), *parts
    )


def maturity_label(funnel: DataFrame) -> DataFrame:
    """Cohort size and maturity date of a rolling funnel as display text."""
    return funnel.select(
        thousands(F.coalesce("total_customers", F.lit(0))).alias("customers_text"),
        short_date(F.col("post_end_date")).alias("post_end_label"),
    )
