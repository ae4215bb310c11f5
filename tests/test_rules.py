"""Boundaries of the purchase rules."""

import pytest
from pyspark.sql import functions as F

from quire.operators import rules
from quire.plans.purchases import sections

SCHEMA = (
    "amount double, federal_amount double, award string, years double, selection string, justification string, related array<double>, split_intent boolean, description string, "
    "accesses_data boolean, accesses_phi boolean, it_services boolean, displaces boolean, commercial boolean, exception string, duration_days int"
)


def request(spark, amount, federal=0.0, award=None, years=1.0, selection=None, justification=None, related=(), intent=False, text="", commercial=None, exception=None, days=None):
    row = (float(amount), float(federal), award, years, selection, justification, [float(x) for x in related], intent, text, None, None, None, None, commercial, exception, days)
    base = rules.sole_source(rules.evaluated(rules.funding(spark.createDataFrame([row], SCHEMA))))
    out = rules.thresholds(rules.split_orders(base), sections(spark))
    return rules.source_keys(rules.forms(rules.categories(rules.covered_services(out)))).first()


@pytest.mark.parametrize(
    "amount,federal,award,need",
    [(14_999.99, 14_999.99, "contract", False), (15_000, 15_000, "contract", True), (49_999.99, 49_999.99, "grant", False), (50_000, 50_000, "grant", True), (99_999.99, 0, None, False), (100_000, 0, None, True)],
)
def test_form_threshold(spark, amount, federal, award, need):
    assert request(spark, amount, federal, award).form_required is need


@pytest.mark.parametrize("amount,quotes,bid,flag", [(100_000, 1, False, None), (100_001, 2, False, None), (249_999, 2, False, None), (250_000, None, True, "SB_CEILING_CONFLICT")])
def test_small_business(spark, amount, quotes, bid, flag):
    got = request(spark, amount, selection="small_business")
    assert (got.quotes, got.bid_required) == (quotes, bid)
    assert flag is None or flag in got.flags


def test_years(spark):
    assert request(spark, 125_000, 125_000, "grant", 5.0).value == 125_000
    assert request(spark, 125_000, years=5.0).value == 25_000


def test_split(spark):
    got = request(spark, 60_000, related=[55_000])
    assert (got.orders_total, got.split_flags) == (115_000, ["competitive_bid"])
    assert request(spark, 100, intent=True).split_flags == ["intent"]


def test_mixed(spark):
    assert request(spark, 80_000, 50_000, "grant").federal_rules
    assert not request(spark, 80_000, 49_999.99, "grant").federal_rules


def test_sole_source(spark):
    assert request(spark, 1, selection="sole_source", justification="price").flags == ["SOLE_SOURCE_INVALID"]
    assert request(spark, 1, selection="sole_source", justification="geographic").justification_ok
    assert request(spark, 1, 1, "contract", selection="sole_source", justification="no_competition").flags == ["SOLE_SOURCE_INVALID"]
    got = request(spark, 3e6, 3e6, "contract", selection="sole_source", justification="emergency")
    assert got.pricing_required and rules.FORMS[6] in got.forms and "COST_PRICING" in got.source_keys


def test_covered_services(spark):
    got = request(spark, 100_001, text="Janitorial work and data security", days=91)
    assert (got.services, got.notice_required, got.parity_required) == (["janitorial"], True, True)
    assert request(spark, 100_000, text="janitorial", days=91).notice_required is False
    assert request(spark, 1, text="security guards").services == ["security"]
    assert request(spark, 1, text="laundry", exception="whim").prohibited


def test_equipment(spark):
    items = spark.createDataFrame([(4999.0, False), (5000.0, False), (1500.0, True), (1499.0, True)], "cost double, before_2004 boolean")
    assert [r.must_tag for r in rules.equipment(items).collect()] == [False, True, True, False]


def test_cart(spark):
    rows = [("100000", "1", "0", "0", "non_federal", 1, True, True), ("14999", "1", "0", "0", "federal_contract", 1, True, True), ("5", None, None, "0", "unknown", 2, False, True)]
    carts = spark.createDataFrame(rows, "subtotal string, tax string, shipping string, handling string, funding string, suppliers int, reviewed boolean, single boolean")
    carts = carts.withColumns({c: F.col(c).cast("decimal(14,2)") for c in ("subtotal", "tax", "shipping", "handling")})
    a, b, c = rules.cart_guide(carts).collect()
    assert (a.required, b.required, c.status) == (True, True, "needs_details")
    assert c.questions == ["reviewed", "suppliers", "funding", "shipping"]
