"""Per-row business rules: request contract, drivers, interventions, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import written_table
from .clean import month_name, month_number

# Fixed values: (column, lowest, highest, required) of the request contract.
REQUEST_RANGES = [
    ("lead_time", 0, None, True),
    ("arrival_date_year", 1900, 2100, False),
    ("arrival_date_week_number", 1, 53, False),
    ("arrival_date_day_of_month", 1, 31, False),
    ("stays_in_weekend_nights", 0, None, False),
    ("stays_in_week_nights", 0, None, False),
    ("adults", 1, 20, True),
    ("children", 0, 20, False),
    ("babies", 0, 20, False),
    ("is_repeated_guest", 0, 1, False),
    ("previous_cancellations", 0, 20, False),
    ("previous_bookings_not_canceled", 0, 50, False),
    ("adr", 0, C.ADR_MAX_VALID, False),
    ("required_car_parking_spaces", 0, 10, False),
    ("total_of_special_requests", 0, 10, False),
]
REQUEST_TEXT = [
    "hotel", "arrival_date", "arrival_date_month", "meal", "country", "market_segment",
    "distribution_channel", "reserved_room_type", "deposit_type", "agent", "company",
    "customer_type",
]

# Feature families used by the importance report.
FEATURE_FAMILIES = {
    "Time": ["lead_time", "is_late_window", "month_sin", "month_cos"],
    "Booking source": ["deposit_type", "agent", "company", "had_company"],
    "Demand origin": ["country", "market_segment", "distribution_channel"],
    "Price": ["adr", "adr_per_person", "revenue_at_risk"],
    "Guest history": ["previous_cancellations", "previous_bookings_not_canceled",
                      "is_repeated_guest"],
}


def feature_family(feature: Column, families=None, default: str = "Other") -> Column:
    families = families or FEATURE_FAMILIES
    out = F
    for family, members in families.items():
        out = out.when(feature.isin(members), family)
    return out.otherwise(default)


def risk_tier(p: Column, medium: float = C.TIER_MEDIUM, high: float = C.TIER_HIGH) -> Column:
    return F.when(p >= high, "high").when(p >= medium, "medium").otherwise("low")


def risk_tier_right_closed(p: Column) -> Column:
    """Band rule of the explainability report: a score on the edge stays in the lower band."""
    return F.when(p > C.TIER_HIGH, "high").when(p > C.TIER_MEDIUM, "medium").otherwise("low")


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _deposit() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("deposit_type"), F.lit(""))))


def _texts(pairs: list[tuple[Column | None, Column | str]]) -> Column:
    texts = [F.lit(t) if isinstance(t, str) else t for _, t in pairs]
    return F.array_compact(F.array(*[
        t if cond is None else F.when(cond, t) for (cond, _), t in zip(pairs, texts)
    ]))


def risk_drivers() -> Column:
    """Texts of the warning rules that fire, at most five, in rule order."""
    segment = F.trim(F.coalesce(F.col("market_segment"), F.lit("")))
    # Wording of the warnings.
    fired = _texts([
        (_deposit() == "non refund",
         "Non-Refund deposit — in booking data this deposit type correlates with higher dropout "
         "rates."),
        (_plain("lead_time") >= 120,
         F.concat(F.lit("Booked "), _plain("lead_time").cast("int"),
                  F.lit(" days in advance — very long lead times increase dropout risk."))),
        (_plain("is_repeated_guest") == 0,
         "First-time guest — no prior booking history to indicate loyalty."),
        (_plain("total_of_special_requests") == 0,
         "No special requests made — lower engagement signal."),
        (_plain("required_car_parking_spaces") == 0,
         "No parking needed — slightly lower commitment signal."),
        (segment.isin("Groups", "Online TA"),
         F.concat(segment,
                  F.lit(" bookings tend to have higher cancellation rates in our data."))),
        (_plain("previous_cancellations") > 0,
         F.concat(F.lit("The guest has "), _plain("previous_cancellations").cast("int"),
                  F.lit(" previous cancellation(s) on record."))),
    ])
    quiet = F.array(F.lit("No strong warning signal was triggered for this booking."))
    return F.when(F.size(fired) == 0, quiet).otherwise(F.slice(fired, 1, 5))


def interventions(p: Column, max_f1: float, high_precision: float) -> Column:
    """Suggested actions by tier and booking, without repeats, at most six."""
    tier = risk_tier(p)
    likely = p >= max_f1
    # Wording of the actions.
    return F.slice(F.array_distinct(_texts([
        (tier == "high", "Call or message the guest now to confirm they are still coming."),
        (tier == "high",
         "Hold a small room buffer for this arrival date in case this booking falls through."),
        (tier == "medium", "Send automated reminders at 72 h and 24 h before arrival."),
        (tier == "medium",
         "Check room availability — review this booking manually if inventory is tight."),
        (tier == "low", "No action needed — continue with the standard booking flow."),
        (_plain("lead_time") >= 120,
         "Set up a reconfirmation schedule: contact the guest at 90, 30 and 7 days before "
         "arrival."),
        (_deposit().isin("no deposit", "refundable") & likely,
         "Request a deposit or card pre-authorisation to strengthen the guest's commitment."),
        (_plain("previous_cancellations") > 0,
         "Call or email this guest personally — they have cancelled a booking before."),
        (_plain("total_of_special_requests") == 0,
         "Ask the guest if they have any special requests — this increases booking engagement."),
        ((_plain("is_repeated_guest") == 0) & likely,
         "Consider a small loyalty incentive (room upgrade or F&B voucher) to build commitment."),
        (p >= high_precision,
         "Flag this booking for daily monitoring in your reservations system."),
    ])), 1, 6)


def recommended_action(tier: Column) -> Column:
    # Wording of the short action text.
    return (
        F.when(tier == "high",
               "Contact the guest within 24 hours to confirm intent. "
               "Consider an overbooking buffer for the arrival date.")
        .when(tier == "medium",
              "Send a gentle reminder one week before arrival. "
              "Monitor cancellation rate in this cohort during the next quarter.")
        .otherwise("Standard handling. No proactive outreach required.")
    )


def normalise_request(df: DataFrame) -> DataFrame:
    """Full or three-letter month to month name; parts and ISO week from the date if absent."""
    given = F.initcap(F.trim("arrival_date_month"))
    short = F.array(*[F.lit(m[:3]) for m in C.MONTHS])
    number = F.coalesce(month_number(given), F.nullif(F.array_position(short, given), F.lit(0)))
    date = F.col("arrival_date")
    blank = F.trim("arrival_date_month") == ""
    return df.withColumns({
        "_month_given": F.when(~blank, F.col("arrival_date_month")),
        "_month": month_name(number.cast("int")),
    }).withColumns({
        "_conflict": F.array_compact(F.array(
            F.when(F.col("arrival_date_year") != F.year(date),
                   "arrival_date_year conflicts with arrival_date"),
            F.when(F.col("_month") != F.date_format(date, "MMMM"),
                   "arrival_date_month conflicts with arrival_date"),
            F.when(F.col("arrival_date_day_of_month") != F.day(date),
                   "arrival_date_day_of_month conflicts with arrival_date"),
        )),
        "arrival_date_year": F.coalesce(F.year(date), F.col("arrival_date_year")),
        "arrival_date_month": F.coalesce(F.date_format(date, "MMMM"), F.col("_month")),
        "arrival_date_day_of_month": F.coalesce(F.day(date), F.col("arrival_date_day_of_month")),
        "arrival_date_week_number": F.coalesce(
            F.col("arrival_date_week_number"), F.weekofyear(date)),
    })


def request_reasons(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Add ``reasons``: every contract rule the row breaks (empty means valid).

    ``ids`` are columns carried along; any other unknown column is a broken rule.
    """
    allowed = {c for c, *_ in REQUEST_RANGES} | set(REQUEST_TEXT) | set(ids)
    extra = sorted(set(df.columns) - allowed)
    df = df.withColumns({
        c: F.lit(None).cast("int") for c, *_ in REQUEST_RANGES if c not in df.columns
    }).withColumns({
        c: F.lit(None).cast("date" if c == "arrival_date" else "string")
        for c in REQUEST_TEXT if c not in df.columns
    })
    checked = normalise_request(df)
    ranges = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v"),
                 F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"),
                 F.lit(required).alias("required"))
        for n, low, high, required in REQUEST_RANGES
    ])
    broken = F.filter(ranges, lambda r: (r.required & r.v.isNull()) | (r.v < r.low)
                      | (r.v > r.high))
    range_texts = F.transform(broken, lambda r: F.concat(r["name"], F.when(
        r.v.isNull(), F.lit(" is required")).otherwise(F.lit(" is out of range"))))
    other = F.array_compact(F.array(
        F.when(F.coalesce(F.length("hotel"), F.lit(0)) < 1, "hotel is required"),
        F.when(F.col("_month_given").isNotNull() & F.col("_month").isNull(),
               "arrival_date_month must be a full month name"),
        F.when(F.col("arrival_date_year").isNull() | F.col("arrival_date_month").isNull()
               | F.col("arrival_date_day_of_month").isNull(),
               "arrival_date or all arrival_date parts are required"),
        *[F.when(F.col(c).isNotNull(), f"{c} is not a known field") for c in extra],
    ))
    reasons = F.concat(range_texts, other, F.col("_conflict"))
    return checked.withColumn("reasons", reasons).drop("_month_given", "_month", "_conflict")


def split_requests(df: DataFrame, ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the rejected ones with their reasons.

    The judged rows are written once, as both results read them.
    """
    judged = written_table(request_reasons(df, ids), "judged-requests")
    ok = F.size("reasons") == 0
    return judged.filter(ok).drop("reasons"), judged.filter(~ok)
