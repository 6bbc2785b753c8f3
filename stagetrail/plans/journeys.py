"""The customer-journey analyses, each one call over the three logs.

Every method returns a DataFrame; nothing runs until it is read. ``as_of`` stands for "now".
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from ..functions import TimeWindow, json_int, rolling
from ..functions.time import cutoff_date
from ..operators import (
    StageSpec,
    assigned_cancel_edges,
    booking_intervals,
    churn_classified,
    churn_matrix,
    cohort_delta,
    cohort_flag_cooccurrence,
    cohort_top_events,
    event_search_by_period,
    first_time_users,
    headline_rates,
    interval_event_coverage,
    metrics_snapshot,
    overall_mixed_funnel,
    period_stage_distincts,
    reach_funnel,
    stage_dropoff,
    stage_first_times,
    strict_sequence_funnel,
    time_to_cancel_by_initiator,
    variant_ranking,
    variant_times,
)
from ..operators.churn import cancel_stages, initiator_is, initiator_starts
from ..operators.timeline import SLICE_MINUTES
from ..sources import APP_LOG, BOOKING_LOG, TASK_LOG, read_log, union_logs
from . import vocabulary as v


def _local(lo: str | None, hi: str | None = None, **bounds) -> TimeWindow:
    return TimeWindow(lo, hi, v.LOCAL_SHIFT_MINUTES, **bounds)


@dataclass(frozen=True)
class Journeys:
    bookings: DataFrame
    tasks: DataFrame
    app: DataFrame
    as_of: datetime
    #: Length of the clock slices in which bookings and events are put in order; shorter ones split a busy entity.
    slice_minutes: int = SLICE_MINUTES

    @staticmethod
    def read(spark, booking_path: str, task_path: str, app_path: str, as_of: datetime) -> Journeys:
        return Journeys(
            read_log(spark, booking_path, BOOKING_LOG),
            read_log(spark, task_path, TASK_LOG),
            read_log(spark, app_path, APP_LOG),
            as_of,
        )

    # Bookings and tasks -------------------------------------------------------------------------

    @property
    def _booking_and_task_log(self) -> DataFrame:
        return union_logs(self.bookings, self.tasks)

    def _booked(self, window: TimeWindow) -> StageSpec:
        return StageSpec("booked", (v.BOOKED,), window, source="booking", key_floor=v.KEY_FLOOR)

    def _reach(self, cohort: TimeWindow, task_window: TimeWindow, cutoff=None) -> DataFrame:
        stages = [
            *[StageSpec(e, (e,), source="booking", key_floor=v.KEY_FLOOR) for e in v.BOOKING_STAGES],
            *[StageSpec(e.lower(), (e,), task_window, source="task", key_floor=v.KEY_FLOOR) for e in v.TASK_STAGES],
            StageSpec(v.CANCELLED, (v.CANCELLED,), source="booking", key_floor=v.KEY_FLOOR),
        ]
        return reach_funnel(self._booked(cohort), self._booking_and_task_log, stages, cutoff)

    def reach_pre(self) -> DataFrame:
        """How far bookings of the earlier period got."""
        return self._reach(_local(v.PRE_START, v.PRE_END), _local(v.PRE_TASK_START, v.PRE_TASK_END))

    def reach_post(self) -> DataFrame:
        """How far matured bookings of the later period got by now."""
        return self._reach(
            rolling(v.POST_START, self.as_of, v.MATURITY_DAYS, v.LOCAL_SHIFT_MINUTES),
            _local(v.POST_TASK_START, not_after=self.as_of),
            cutoff_date(self.as_of, v.MATURITY_DAYS),
        )

    def reach_post_matured(self) -> DataFrame:
        """The later period up to a fixed, matured end."""
        return self._reach(_local(v.POST_START, v.MATURED_END), _local(v.POST_TASK_START, v.MATURED_TASK_END))

    def churn(self) -> DataFrame:
        """Stuck stage by kind of cancellation and delay, matured bookings of the later period."""
        window = rolling(v.POST_START, self.as_of, v.MATURITY_DAYS, v.LOCAL_SHIFT_MINUTES)
        stages = [
            *[StageSpec(f"t_{e}", (e,), source="booking") for e in v.BOOKING_STAGES],
            *[StageSpec(f"t_{e.lower()}", (e,), source="task") for e in v.TASK_STAGES],
        ]
        cancels = cancel_stages(
            v.CANCELLED, initiator_is(v.CUSTOMER, v.INITIATOR_KEY), initiator_starts(v.SYSTEM, v.INITIATOR_KEY), "booking"
        )
        times = stage_first_times(self._booked(window), self._booking_and_task_log, [*stages, *cancels])
        classified = churn_classified(times, [s.name for s in stages], v.OVERDUE_HOURS, self.as_of)
        return churn_matrix(classified, len(stages), v.OVERDUE_HOURS)

    # Booking intervals --------------------------------------------------------------------------

    def _intervals(self, window: TimeWindow) -> DataFrame:
        return booking_intervals(self.bookings, v.BOOKED, window, v.TRANSACTION_KEY, v.KEY_FLOOR, slice_minutes=self.slice_minutes)

    def _events(self, log: DataFrame, start: str, *names: str) -> DataFrame:
        """Events that can follow a booking made from ``start`` on."""
        window = _local(start)
        return log.filter(
            log.event_name.isin(*names) & (log.entity >= v.KEY_FLOOR) & window.contains(log.event_time)
        )

    def ssid_coverage(self) -> DataFrame:
        """Bookings of each period with either kind of SSID event before the next booking."""
        return interval_event_coverage(
            {
                "PRE": self._intervals(_local(v.PRE_START, v.PRE_END)),
                "POST": self._intervals(_local(v.POST_START, v.POST_END)),
            },
            self._events(self.bookings, v.PRE_START, v.SSID_SET, v.SSID_CAPTURED),
            (v.SSID_SET, v.SSID_CAPTURED),
            "any_ssid_cnt",
            slice_minutes=self.slice_minutes,
        )

    def time_to_cancel(self) -> DataFrame:
        """Hours from assignment to cancellation, by who cancelled."""
        return time_to_cancel_by_initiator(
            self._intervals(_local(v.PRE_START, v.PRE_END)),
            self._events(self.tasks, v.PRE_START, v.ASSIGNED),
            self._events(self.bookings, v.PRE_START, v.CANCELLED),
            v.INITIATOR_KEY,
            slice_minutes=self.slice_minutes,
        )

    def cancel_edges(self) -> DataFrame:
        """What preceded the cancellation of assigned bookings."""
        return assigned_cancel_edges(
            self._intervals(_local(v.PRE_START, v.PRE_END)),
            union_logs(
                self._events(self.tasks, v.PRE_START, v.ASSIGNED, v.REACHED_HOME), self._events(self.bookings, v.PRE_START, v.CANCELLED)
            ),
            v.ASSIGNED,
            v.REACHED_HOME,
            v.CANCELLED,
            initiator_is(v.CUSTOMER, v.INITIATOR_KEY),
            initiator_is(v.SYSTEM, v.INITIATOR_KEY),
            slice_minutes=self.slice_minutes,
        )

    # App log ------------------------------------------------------------------------------------

    def installer_funnel(self) -> DataFrame:
        """First-time installers of both periods and the app stages they reached."""
        window = TimeWindow(v.APP_EVENTS_START, v.APP_EVENTS_END)
        stages = [StageSpec(n, e, window) for n, e in v.APP_STAGES.items() if n != "location_confirm"]
        return period_stage_distincts(
            {
                "PRE": self._first_timers(v.APP_INSTALLED, TimeWindow(v.PRE_START, v.PRE_END), v.INSTALL_COUNT_KEY),
                "POST": self._first_timers(v.APP_INSTALLED, TimeWindow(v.POST_START, v.POST_END), v.INSTALL_COUNT_KEY),
            },
            self.app,
            stages,
        )

    def _first_timers(self, event: str, window: TimeWindow, counter_key: str) -> StageSpec:
        return StageSpec("first_timers", (event,), window, lambda payload: json_int(payload, counter_key) == 1)

    @property
    def _release(self) -> TimeWindow:
        return rolling(v.RELEASE_START, self.as_of, v.MATURITY_DAYS)

    def _ordered_stages(self) -> list[StageSpec]:
        return [StageSpec(n, v.APP_STAGES[n], self._release) for n, _ in v.ORDERED_LINKS]

    def release_funnel(self) -> DataFrame:
        """The new release: unordered top of the funnel, then the ordered tail."""
        top = rolling(v.RELEASE_TOP_START, self.as_of, v.MATURITY_DAYS)
        unordered = [
            StageSpec("app_installed", (v.APP_INSTALLED,), self._release),
            *[
                StageSpec(n, v.APP_STAGES[n], top)
                for n in ("homepage", "check_clicked", "serviceable", "unserviceable", "how_works")
            ],
        ]
        return overall_mixed_funnel(
            self.app,
            unordered,
            v.GET_STARTED,
            self._release,
            v.VARIANT_KEY,
            v.VARIANTS,
            self._ordered_stages(),
            v.ORDERED_LINKS,
        )

    def variant_funnel(self) -> DataFrame:
        """The ordered funnel per experiment variant."""
        times = variant_times(
            self.app, v.GET_STARTED, self._release, v.VARIANT_KEY, v.VARIANTS, self._ordered_stages()
        )
        return strict_sequence_funnel(times, v.ORDERED_LINKS).orderBy("variant")

    def serviceability_search(self) -> DataFrame:
        """Users per period of every event about serviceability."""
        return event_search_by_period(
            self.app,
            v.SERVICEABILITY_TEXT,
            {"PRE": TimeWindow(v.PRE_START, v.PRE_END), "POST": TimeWindow(v.POST_START, v.POST_END)},
        )

    def first_loader_top_events(self, k: int = 30) -> DataFrame:
        """What first-time homepage users of the later period did most."""
        window = TimeWindow(v.POST_START, v.POST_END)
        cohort = first_time_users(self.app, v.HOMEPAGE, window, v.HOMEPAGE_COUNT_KEY)
        return cohort_top_events(cohort, self.app, window, k)

    def first_loader_serviceability(self) -> DataFrame:
        """Which serviceability pages first-time homepage users saw, with and without a click."""
        window = TimeWindow(v.POST_START, v.POST_END)
        return cohort_flag_cooccurrence(
            self._first_timers(v.HOMEPAGE, window, v.HOMEPAGE_COUNT_KEY),
            self.app,
            window,
            [StageSpec(n, e, window) for n, e in v.SERVICEABILITY_FLAGS.items()],
            "clicked",
        )

    # Reports ------------------------------------------------------------------------------------

    def post_dropoff(self) -> DataFrame:
        return stage_dropoff(self.reach_post(), self._steps())

    def post_delta(self) -> DataFrame:
        """Drop-off of the later period against the earlier one."""
        return cohort_delta(self.post_dropoff(), stage_dropoff(self.reach_pre(), self._steps()))

    def post_headline(self) -> DataFrame:
        return headline_rates(self.reach_post(), "total_customers", "otp_verified")

    def ranked_variants(self) -> DataFrame:
        return variant_ranking(self.variant_funnel(), "get_started", "fee_captured", v.VARIANTS)

    def snapshot(self, stamp_suffix: str = "") -> DataFrame:
        """The metrics record of one refresh; see ``write_snapshot``."""
        return metrics_snapshot(
            self.reach_post(),
            self.release_funnel(),
            self.variant_funnel(),
            self.as_of,
            v.POST_METRICS,
            v.RELEASE_METRICS,
            v.VARIANT_METRICS,
            v.VARIANTS,
            stamp_suffix,
        )

    @staticmethod
    def _steps() -> list[str]:
        return ["total_customers", *v.BOOKING_STAGES, *[e.lower() for e in v.TASK_STAGES]]
