"""Statements about sponsorship and how each one reads; the wording covers every branch of the decision."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import sponsorship

MATCH = ("match", "likely", "high")
NO = ("no_match", "unlikely", "high")
REVIEW = ("review", "unknown", "low")
SILENT = ("review", "unknown", "unknown")
READINGS = [
    ("Visa sponsorship is available for qualified candidates.", MATCH),
    ("This role does not offer sponsorship.", NO),
    ("We sponsor employee learning programs and community events.", SILENT),
    ("We sponsor work visas in some cases, but this role has no sponsorship.", REVIEW),
    ("This role does not currently offer visa sponsorship.", NO),
    ("Must be eligible to work in the United States; no H1-B visa sponsorship available.", NO),
    ("It is not true that we cannot sponsor work visas.", REVIEW),
    ("There is no relocation budget, and visa sponsorship is available for this role.", MATCH),
    ("Candidates must be eligible to obtain the required authorizations without sponsorship for an export license.", REVIEW),
    ("Access to export-controlled data is required. We do not provide visa sponsorship for this role.", NO),
    ("Visa sponsorship is available for this role, though sponsorship is not guaranteed.", MATCH),
    ("Visa sponsorship: we do sponsor visas. That said, we are not able to sponsor visas for every role and every candidate.", MATCH),
    ("We are not able to sponsor every candidate who applies.", REVIEW),
    ("We offer green card sponsorship to existing employees after two years. We are unable to sponsor visas for all new hires.", REVIEW),
    ("We are unable to sponsor visas for all new hires.", REVIEW),
    ("Our immigration team supports H-1B and green card cases, but we do not sponsor all roles.", REVIEW),
    ("We are unable to sponsor visas for all new hires. This role does not offer sponsorship.", NO),
    ("We cannot sponsor visas at all for this position.", NO),
    ("All roles require work authorization without sponsorship.", NO),
    ("Limited immigration sponsorship may be available for this role.", REVIEW),
    ("We sponsor H-1B visas, and relocation may be discussed separately.", MATCH),
    ("We sponsor visas for this role. We do not offer relocation assistance.", MATCH),
    ("We do not sponsor community events.", SILENT),
    ("We do not offer relocation or visa sponsorship.", NO),
    ("We cannot extend visa sponsorship for this position.", NO),
    ("We do not discriminate against candidates who need visa sponsorship.", SILENT),
    ("We do not offer relocation or housing or transit or gym or childcare or visa sponsorship.", SILENT),
    ("We are unable, given current headcount constraints for this particular opening, to offer visa sponsorship.", REVIEW),
    ("This role does not offer sponsorship. We are unable, given current headcount constraints, to offer visa sponsorship.", NO),
    ("Build backend services in Go. Competitive salary and equity.", SILENT),
    ("We provide relocation and immigration support. We cannot sponsor every applicant.", MATCH),
    ("Applicants must be US citizens only.", NO),
    ("Permanent resident only for this role.", NO),
    ("GC only.", NO),
    ("Citizenship is required for this position.", NO),
    ("Must be a U.S. citizen.", NO),
    ("We cannot currently sponsor or support visa transfers.", NO),
    ("We do not sponsor or support local charities.", SILENT),
    ("Applicants must be authorized to work in the U.S. without the need for current or future visa sponsorship.", NO),
    ("Applicants must not require sponsorship now or at any time in the future.", NO),
    ("We are not currently sponsoring employment-based visas.", NO),
    ("Citizenship required: Yes", NO),
    ("Citizenship required: No", SILENT),
    ("U.S. Citizenship Required? Yes", NO),
    ("Visa: GC/Citizens", NO),
    ("Visa: GC/Citizens/H-1B", SILENT),
    ("The successful candidate must hold U.S. citizenship or lawful permanent resident status.", NO),
    ("Applicants must be green card holders, EAD holders or H-1B transfer candidates.", ("match", "likely", "high")),
    ("If approved by counsel, the company will sponsor H-1B candidates.", REVIEW),
    ("Subject to internal approval, we sponsor work visas for this role.", REVIEW),
    ("If you are interested in this role, we offer visa sponsorship.", MATCH),
    ("We are unable to sponsor new H-1B petitions; H-1B transfer candidates are encouraged to apply.", REVIEW),
    ("We are unable to sponsor new H-1B petitions.", NO),
    ("H-1B sponsorship is unavailable.", NO),
    ("Visa sponsorship: not available.", NO),
    ("Initial sponsorship is unavailable.", NO),
    ("H-1B sponsorship is available for candidates who are not yet authorized to work in the US.", MATCH),
    ("H-1B sponsorship for engineering roles in our Austin, Texas office is not offered.", REVIEW),
    ("We sometimes sponsor H-1B visas.", REVIEW),
    ("We are happy to sponsor and will handle your visa.", MATCH),
    ("", SILENT),
    (None, SILENT),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in READINGS)), "id int, text string").coalesce(1)
    return {r.id: r for r in sponsorship.assessed(rows, "text", "id").collect()}


@pytest.mark.parametrize("i", range(len(READINGS)))
def test_reading(read, i):
    r = read[i]
    assert (r.decision, r.verdict, r.confidence) == READINGS[i][1], (READINGS[i][0], r.evidence)


def test_evidence_names_rule_and_phrase(read):
    by_text = {t: read[i] for i, (t, _) in enumerate(READINGS)}
    assert by_text["We cannot sponsor visas at all for this position."].evidence == "negative verb: can not sponsor"
    assert by_text["This role does not currently offer visa sponsorship."].evidence == "negated_offer visa_offer: offer visa sponsorship"
    assert by_text["Must be a U.S. citizen."].evidence == "negative citizens_only: must be a us citizen" and by_text["Must be a U.S. citizen."].signal


def test_signature_follows_the_kind_of_evidence(read):
    by_text = {t: read[i] for i, (t, _) in enumerate(READINGS)}
    assert by_text["GC only."].signature == by_text["Must be a U.S. citizen."].signature != by_text["H-1B sponsorship is unavailable."].signature


def test_far_statements_in_long_texts(spark):
    filler = "Lorem ipsum dolor. " * 5000
    rows = [(1, filler + "This role does not offer sponsorship. " + filler), (2, filler + "We sponsor work visas." + filler), (3, filler)]
    got = sponsorship.assessed(spark.createDataFrame(rows, "id int, text string"), "text", "id").select("id", F.col("decision")).collect()
    assert {tuple(r) for r in got} == {(1, "no_match"), (2, "match"), (3, "review")}
