"""Bands of pay: what is read out of statements, and what is refused."""

import pytest

from siftline.functions import pay

READINGS = [
    # text, salary, total, low, high, reason
    ("The base salary range is $120,000 - $150,000 per year.", "120000-150000 USD/year ", "", 120000, 150000, None),
    ("Base salary: $115,000-$152,500.", "115000-152500 USD/year Base salary", "", 115000, 152500, None),
    ("The hourly rate for this role is $21 to $25.", "21-25 USD/hour this role is", "", None, None, "pay_stated_not_annual"),
    ("Compensation: $21/hr to $25/hr", "21-25 USD/hour Compensation", "", None, None, "pay_stated_not_annual"),
    ("Pay range 60k-80k EUR", "", "", None, None, "pay_stated_but_unparsed"),
    ("Pay range EUR 60k-80k", "60000-80000 EUR/year ", "", 60000, 80000, None),
    ("Base pay USD €60,000-€80,000 per year", "60000-80000 EUR/year ", "", 60000, 80000, None),
    ("Base pay $60,000-€80,000 per year", "", "", None, None, "pay_stated_but_unparsed"),
    ("Base pay £80,000 to £60,000 annually", "60000-80000 GBP/year ", "", 60000, 80000, None),
    ("On-target earnings (OTE): $200,000 - $300,000.", "", "200000-300000 USD/year On-target earnings (OTE)", None, None, "pay_stated_but_unparsed"),
    ("A fully remote job with a base salary of $100,000 - $120,000.", "100000-120000 USD/year ", "", 100000, 120000, None),
    ("Annual salary New York: $140,000 - $175,000. Annual salary Austin: $100,000 - $120,000.", "140000-175000 USD/year Annual salary New York; 100000-120000 USD/year Annual salary Austin", "", 100000, 175000, None),
    ("Annual salary $30,000 - $45,000 for interns; annual salary $400,000 - $500,000 for leads.", "30000-45000 USD/year ; 400000-500000 USD/year ", "", None, None, "pay_bands_conflict"),
    ("Base salary $140,000 - $175,000 and a stipend of $240 - $300 per year.", "140000-175000 USD/year ", "", 140000, 175000, None),
    ("A stipend of $500 - $700 per month.", "", "", None, None, None),
    ("We have 20 to 30 engineers and raised $100 - $200 million.", "", "", None, None, None),
    ("Base salary $3240 - $5000 per month", "", "", None, None, "pay_stated_but_unparsed"),
    ("Base salary 60,000.000 - 80,000 USD", "", "", None, None, "pay_stated_but_unparsed"),
    ("Base salary $60,000.00 - $80,000.50 per year", "60000-80001 USD/year ", "", 60000, 80001, None),
    ("Base salary of $10,000 - $200,000 a year", "", "", None, None, "pay_stated_but_unparsed"),
    ("Base pay $50 per hour to $90,000 per year", "", "", None, None, "pay_stated_but_unparsed"),
    ("", "", "", None, None, None),
    (None, "", "", None, None, None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(READINGS)], "id int, text string").coalesce(1)
    at = pay.with_bands(rows, "text", "id")
    return {r.id: r for r in at.select("id", pay.said("salary").alias("salary"), pay.said("total").alias("total"), "low", "high", "reason").collect()}


@pytest.mark.parametrize("i", range(len(READINGS)))
def test_reading(read, i):
    assert tuple(read[i])[1:] == READINGS[i][1:], READINGS[i][0]


def test_offsets_in_long_texts(spark):
    filler = "wörds " * 3000
    rows = spark.createDataFrame([(1, filler + "Base salary $100,000 - $120,000. " + filler + "Annual salary in Zürich EUR 90k - 95k")], "id int, text string")
    bands = pay.with_bands(rows, "text", "id").first().salary
    text = rows.first().text
    assert [text[b.at : b.at + 5] for b in bands] == ["$100,", "EUR 9"] and [b.low for b in bands] == [100000, 90000]
