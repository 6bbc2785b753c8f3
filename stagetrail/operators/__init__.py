"""DataFrame-to-DataFrame operators over event logs."""

from .churn import (
    cancel_attribution,
    churn_classified,
    churn_matrix,
    churn_matrix_long,
    stage_first_times,
    stage_overdue_flags,
    stuck_stage,
)
from .cohorts import (
    anchor_events,
    booking_cohort,
    booking_intervals,
    first_booking_cohort,
    first_time_users,
    latest_per_transaction,
    variant_first_touch,
)
from .daily import DailyMasks
from .distinct import distinct_entities, entity_numbers, period_stage_distincts_by_bitmap, with_numbers
from .explore import cohort_top_events, event_names, event_search_by_period
from .funnels import (
    cohort_flag_cooccurrence,
    overall_mixed_funnel,
    period_stage_distincts,
    reach_funnel,
    strict_sequence_funnel,
    variant_times,
)
from .intervals import (
    assigned_cancel_edges,
    interval_attribution,
    interval_event_coverage,
    time_to_cancel_by_initiator,
)
from .pivot import StageSpec, first_event_times
from .report import (
    cohort_delta,
    headline_rates,
    maturity_label,
    metrics_snapshot,
    report_lines,
    stage_dropoff,
    variant_ranking,
)

__all__ = [
    "DailyMasks",
    "StageSpec",
    "anchor_events",
    "assigned_cancel_edges",
    "booking_cohort",
    "booking_intervals",
    "cancel_attribution",
    "churn_classified",
    "churn_matrix",
    "churn_matrix_long",
    "cohort_delta",
    "cohort_flag_cooccurrence",
    "cohort_top_events",
    "distinct_entities",
    "entity_numbers",
    "event_names",
    "event_search_by_period",
    "first_booking_cohort",
    "first_event_times",
    "first_time_users",
    "headline_rates",
    "interval_attribution",
    "interval_event_coverage",
    "latest_per_transaction",
    "maturity_label",
    "metrics_snapshot",
    "overall_mixed_funnel",
    "period_stage_distincts",
    "period_stage_distincts_by_bitmap",
    "reach_funnel",
    "report_lines",
    "stage_dropoff",
    "stage_first_times",
    "stage_overdue_flags",
    "strict_sequence_funnel",
    "stuck_stage",
    "time_to_cancel_by_initiator",
    "variant_first_touch",
    "variant_ranking",
    "variant_times",
    "with_numbers",
]
