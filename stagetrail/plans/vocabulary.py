"""Fixed values of the analyses: event names, payload keys, dates, limits and output names.

They must equal what the logs record and what readers of the results expect.
"""

from __future__ import annotations

# Clocks and key floor.
LOCAL_SHIFT_MINUTES = 330
MATURITY_DAYS = 5
KEY_FLOOR = "5999999999"

# Booking log.
BOOKED = "booking_fee_captured"
CANCELLED = "cancelled"
SSID_SET = "ssid_set"
SSID_CAPTURED = "ssid_captured"
BOOKING_STAGES = ("ssid_set", "address_updated", "booking_verified")

# Task log.
TASK_STAGES = (
    "NOTIF_SENT",
    "INTERESTED",
    "SLOT_SELECTED",
    "CUSTOMER_SLOT_CONFIRMED",
    "ASSIGNED",
    "OTP_VERIFIED",
)
ASSIGNED = "ASSIGNED"
REACHED_HOME = "REACHED_HOME"

# Payload keys. Dots and spaces are part of the key.
TRANSACTION_KEY = "transaction_id"
INITIATOR_KEY = "initiated_by"
INSTALL_COUNT_KEY = "profile.events.App Installed.count"
HOMEPAGE_COUNT_KEY = "profile.events.booking_homepage_loaded.count"
VARIANT_KEY = "event_props.cost_breakdown_flow"
CUSTOMER = "customer"
SYSTEM = "cops"
VARIANTS = ("A", "B", "C", "D")

# App log, stage name to event names.
APP_INSTALLED = "App Installed"
HOMEPAGE = "booking_homepage_loaded"
GET_STARTED = "how_to_get_started_clicked"
APP_STAGES = {
    "homepage": ("booking_homepage_loaded",),
    "check_clicked": ("check_serviceability_clicked", "current_loc_serviceability_check_clicked"),
    "serviceable": ("serviceable_page_loaded",),
    "unserviceable": ("unserviceable_page_loaded",),
    "how_works": ("how_does_it_work_clicked",),
    "get_started": ("how_to_get_started_clicked",),
    "cost_today": ("cost_today_clicked",),
    "pay_100": ("pay_100_to_move_forward_clicked",),
    "location_confirm": ("I_AM_AT_INSTALL_LOCATION_CLICKED",),
    "fee_captured": ("booking_fee_captured",),
}
SERVICEABILITY_FLAGS = {
    "clicked": ("check_serviceability_clicked",),
    "loading_page": ("checking_serviceablity_page_loaded",),
    "serviceable_page": ("serviceable_page_loaded",),
    "unserviceable_page": ("unserviceable_page_loaded",),
}
SERVICEABILITY_TEXT = "serviceab"

# Stage, and the stage it has to follow.
ORDERED_LINKS = (
    ("cost_today", "gs_time"),
    ("pay_100", "cost_today"),
    ("location_confirm", "pay_100"),
    ("fee_captured", "pay_100"),
)

# Hours a stage may take before it counts as overdue.
OVERDUE_HOURS = {4: 48, 5: 48, 6: 48, 7: 6, 8: 24, 9: 24}

# Dates, local for bookings and tasks.
PRE_START, PRE_END = "2026-02-20", "2026-03-26"
PRE_TASK_START, PRE_TASK_END = "2026-02-13", "2026-04-13"
POST_START, POST_END = "2026-03-28", "2026-04-13"
POST_TASK_START = "2026-03-21"
MATURED_END, MATURED_TASK_END = "2026-04-05", "2026-04-15"
APP_EVENTS_START, APP_EVENTS_END = "2026-02-13", "2026-04-22"
RELEASE_START, RELEASE_TOP_START = "2026-04-15", "2026-04-14"

# Metric names of the snapshot and the funnel columns they hold.
POST_METRICS = {
    "total": "total_customers",
    "ssid": "ssid_set",
    "address": "address_updated",
    "verified": "booking_verified",
    "notif": "notif_sent",
    "interested": "interested",
    "slot": "slot_selected",
    "confirmed": "customer_slot_confirmed",
    "assigned": "assigned",
    "otp": "otp_verified",
    "cancelled": "cancelled",
}
RELEASE_METRICS = {
    "installs": "app_installed",
    "homepage": "homepage",
    "check": "check_clicked",
    "serviceable": "serviceable",
    "unserviceable": "unserviceable",
    "how_works": "how_works",
    "get_started": "get_started",
    "cost": "cost_today",
    "pay100": "pay_100",
    "location": "location_confirm",
    "paid": "fee_captured",
}
VARIANT_METRICS = {
    "entry": "get_started",
    "cost": "cost_today",
    "pay100": "pay_100",
    "location": "location_confirm",
    "paid": "fee_captured",
}
