"""What a message about an application says: categories, scheduling steps, a stated time, and the changes that it proposes.

Categories are flags, each by phrases that stand between no letters or digits, their last word inflected. Proposals are never carried
out here: each says whether the link that the message has would allow it, and only an exact link to a role ever does.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: phrases by category, scheduling steps, phases and states

CATEGORIES = {
    "receipt": ("application received", "application has been received", "thanks for applying", "thank you for applying"),
    "assessment": ("assessment", "coding challenge", "online assessment", "take-home", "take home"),
    "interview_invite": ("interview", "phone screen", "virtual screen", "onsite", "on-site", "interview loop"),
    "neutral_status_update": ("application update", "still under consideration", "status update", "next steps"),
    "rejection": (
        "not moving forward", "not move forward", "not to move forward", "will not be moving forward", "will not be proceeding", "decided not to proceed", "not to proceed", "no longer under consideration", "regret to inform",
        "moving forward with another candidate", "position has been filled", "role has been filled",
    ),
    "offer": ("job offer", "offer letter", "pleased to offer", "offer package"),
    "background_check_onboarding": ("background check", "onboarding", "start date", "i-9"),
    "job_alert_digest": ("job alert", "new jobs matching", "recommended jobs"),
    "unrelated": ("unsubscribe", "shipping update", "your order", "invoice", "receipt for your purchase"),
}
SCHEDULING = ("schedule", "scheduling", "availability", "available times", "calendar", "book a time", "reschedule", "rescheduled", "cancelled", "canceled")
BOOKING = ("choose a time", "select a time", "book a time", "send your availability", "share your availability", "available times", "scheduling link")
SUBMITTED = ("my availability", "i am available", "i'm available", "available on", "available at", "booked")
REPLACED = ("replacement", "rescheduled to", "new interview time", "new time is")
CONFIRMED = ("confirmed", "confirmation", "is scheduled", "has been scheduled", "you're scheduled", "you are scheduled")
RESCHEDULE = ("need to reschedule", "please reschedule", "must reschedule", "change the interview time", "change your interview")
CANCELLED = ("interview has been cancelled", "interview has been canceled", "interview is cancelled", "interview is canceled", "cancelling the interview", "canceling the interview")
DONE = ("interview is complete", "interview has concluded", "thank you for interviewing", "completed the assessment")
OUTREACH_IN = ("recruiter", "talent acquisition", "open role", "are you interested")
OUTREACH_OUT = ("reaching out", "interested in the", "my application", "would love to connect")
FOLLOW_UP = ("please reply", "please respond", "please let us know", "action required", "response requested")
EEO = r"equal\s+(?:employment\s+)?opportunity(?:\s*/\s*affirmative\s+action)?(?:\s+employer)?"
INFLECTIONS = ("s", "es", "d", "ed", "ing", "er", "ers")
STATED_TIME = r"\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})[ t,]+([0-9]{1,2}:[0-9]{2})(?:\s*([ap]m))?\s+(utc|gmt|[a-z]{2,4}|america/[a-z_]+(?:/[a-z_]+)?)\b"
STEPS = {
    "booking_requested": ("booking_required", "create_action_needed"), "availability_submitted": ("awaiting_schedule", "move_to_waiting"), "schedule_confirmed": ("scheduled", "confirm_occurrence"),
    "reschedule_requested": ("reschedule_required", "request_reschedule"), "replacement_confirmed": ("scheduled", "append_replacement"), "cancellation": ("action_required", "cancel_occurrence"),
    "awaiting_result": ("awaiting_result", "mark_complete"),
}
PHASES = (
    "application_prep", "application_review", "recruiter_screen", "assessment", "hiring_manager", "technical_interview", "interview_loop", "team_match", "reference_check", "offer", "background_check", "work_authorization", "onboarding", "other",
)
OPEN_STATES = (
    "action_required", "booking_required", "reschedule_required", "in_progress", "decision_required", "follow_up_required", "awaiting_schedule", "reschedule_pending", "waiting_employer", "awaiting_result", "paused", "scheduled",
)


def phrase_pattern(phrases: Sequence[str]) -> str:
    one = lambda p: (r"(?:^|[^a-z0-9])" if p[0].isalnum() else "") + re.escape(p).replace(r"\ ", " ").replace("'", "['’]") + (rf"(?:{'|'.join(INFLECTIONS)})?(?:$|[^a-z0-9])" if p[-1].isalnum() else "")
    return "|".join(map(one, phrases))


def says(text: Column, phrases: Sequence[str]) -> Column:
    return text.rlike(phrase_pattern(phrases))


def steps(text: Column, inbound: Column) -> Column:
    """Names of the scheduling steps of a message in lower case, sorted."""
    timed = text.rlike(STATED_TIME)
    replaced, confirmed = says(text, REPLACED) & says(text, CONFIRMED) & timed, says(text, CONFIRMED) & timed
    found = {
        "availability_submitted": ~inbound & says(text, SUBMITTED), "awaiting_result": says(text, DONE), "booking_requested": inbound & says(text, BOOKING), "cancellation": says(text, CANCELLED),
        "replacement_confirmed": replaced, "reschedule_requested": says(text, RESCHEDULE), "schedule_confirmed": confirmed & ~replaced,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))


def categories(text: Column, inbound: Column, step: Column) -> Column:
    """Names of the categories of a message in lower case, sorted; unknown if it has none. ``step``: what ``steps`` gives."""
    found = {n: says(text, p) for n, p in CATEGORIES.items()}
    found["scheduling"] = says(text, SCHEDULING) | (F.size(F.array_remove(step, "awaiting_result")) > 0)
    found["inbound_recruiter_outreach"] = inbound & (says(text, OUTREACH_IN) | says(F.regexp_replace(text, EEO, " "), ("opportunity",)))
    found["outbound_cold_outreach"] = ~inbound & says(text, OUTREACH_OUT)
    found["follow_up_needed"] = says(text, FOLLOW_UP) | F.array_contains(step, "booking_requested")
    names = F.array_compact(F.array(*[F.when(found[n], F.lit(n)) for n in sorted(found)]))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("unknown")))


def stated_time(text: Column) -> Column:
    """A date and clock that stand with a zone: 2026-01-31T15:00:00; null without all three, or for an hour that there is not."""
    part = lambda i: F.regexp_extract(text, STATED_TIME, i)
    hour, minute = F.nullif(F.substring_index(part(2), ":", 1), F.lit("")).cast("int"), F.substring_index(part(2), ":", -1)
    half = part(3) != ""
    clock = F.when(half & hour.between(1, 12), hour % 12 + F.when(part(3) == "pm", 12).otherwise(0)).when(~half & (hour <= 23), hour)
    at = F.concat(part(1), F.lit("T"), F.lpad(clock.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(":00"))
    return F.when(F.try_to_timestamp(at).isNotNull(), at)


def phase_of(text: Column, category: Column, now: Column) -> Column:
    """The phase a message is about: the one that the role is in, if that is past review, else what its words say."""
    known = now.isNotNull() & ~now.isin("application_prep", "application_review", "unknown")
    return (
        F.when(known, now).when(F.array_contains(category, "assessment"), "assessment").when(says(text, ("recruiter", "talent", "phone screen")), "recruiter_screen").when(says(text, ("hiring manager",)), "hiring_manager")
        .when(says(text, ("technical", "coding", "system design")), "technical_interview").when(says(text, ("onsite", "on-site", "interview loop")), "interview_loop").when(F.array_contains(category, "offer"), "offer").otherwise("other")
    )


def proposals(text: Column, category: Column, step: Column, time: Column, phase: Column, exact: Column, linked: Column, body: Column) -> Column:
    """array<struct<kind, target, ready>>. exact: the message has an exact link to a role; linked: to an application, by a rule or a person."""
    everything = says(text, ("all roles", "all applications", "entire application"))
    status = lambda name, per_role: F.struct(F.lit("status_transition").alias("kind"), F.lit(name).alias("target"), (body & linked & F.when(per_role, exact).otherwise(everything)).alias("ready"))
    has = lambda c: F.array_contains(category, c)
    made = [F.when(has("receipt"), status("applied", exact)), F.when(has("rejection"), status("rejected", exact)), F.when(has("interview_invite"), status("in_progress", F.lit(True)))]
    for name, (state, action) in sorted(STEPS.items()):
        ready = body & exact & (time.isNotNull() if name in ("schedule_confirmed", "replacement_confirmed") else F.lit(True))
        made.append(F.when(F.array_contains(step, name), F.struct(F.lit("progress_calendar").alias("kind"), F.concat_ws("/", phase, F.lit(state), F.lit(action)).alias("target"), ready.alias("ready"))))
    made.append(F.when(has("offer"), F.struct(F.lit("progress").alias("kind"), F.lit("offer/waiting_employer").alias("target"), (body & exact & linked).alias("ready"))))
    return F.array_compact(F.array(*made))


def progress_after(status: Column, phase: Column, state: Column, label: Column) -> Column:
    """struct<phase, state, label> that a status stands for, given what there was: nothing is guessed."""
    known = phase.isin(*PHASES)
    kept = F.when(known, phase).otherwise("other")
    named = F.nullif(F.when(known, label).otherwise(F.coalesce(F.nullif(label, F.lit("")), status)), F.lit(""))
    none = F.lit(None).cast("string")
    struct = lambda p, s, n: F.struct(p.alias("phase"), s.alias("state"), n.alias("label"))
    return (
        F.when(status == "drafted", struct(F.lit("application_prep"), F.lit("action_required"), none)).when(status == "applied", struct(F.lit("application_review"), F.lit("waiting_employer"), none))
        .when(status.isin("rejected", "ignored"), struct(kept, F.lit("closed"), named)).otherwise(struct(kept, F.when(state.isin(*OPEN_STATES), state).otherwise("unknown"), named))
    )
