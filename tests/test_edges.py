"""Hand-made edge frames: ties, same-day orders, zero denominators, missing
targets, line-less orders, category mixes, profit exactly 0, the 49.995 %
boundary and fewer rows than NTILE buckets."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.plans import customers, geo_time, products_targets, sales, validation, views
from tillroll.sources.tables import Star, customer_key

D = dt.date


def make_star(spark, customers_rows, orders_rows, lines_rows, subcats, targets):
    dim_c = spark.createDataFrame(customers_rows, "customer_name string, state string, city string") \
        .withColumn("customer_id", customer_key("customer_name", "state", "city"))
    o = spark.createDataFrame(orders_rows, "order_id long, customer_name string, state string, "
                                           "city string, order_date date")
    wide = o.withColumn("customer_id", customer_key("customer_name", "state", "city"))
    lines = spark.createDataFrame(
        [(a, b, Decimal(c), Decimal(d), e) for a, b, c, d, e in lines_rows],
        "order_id long, sub_category string, amount decimal(18,4), profit decimal(18,4), quantity int")
    dim_s = spark.createDataFrame(subcats, "sub_category string, category string")
    tgt = spark.createDataFrame([(m, c, Decimal(t)) for m, c, t in targets],
                                "target_month date, category string, target_amount decimal(18,2)")
    return Star(dim_c.select("customer_id", "customer_name", "state", "city"), dim_s,
                wide.select("order_id", "customer_id", "order_date"), lines, tgt, wide)


CUSTOMERS = [("Ann", "North", "N1"), ("Bob", "North", "N1"), ("Cid", "South", "S1"),
             ("Dee", "South", "S1"), ("Eve", "West", "W1")]
ORDERS = [
    (1, "Ann", "North", "N1", D(2018, 4, 2)),
    (2, "Ann", "North", "N1", D(2018, 4, 2)),     # same day as order 1
    (3, "Ann", "North", "N1", D(2018, 6, 1)),
    (4, "Bob", "North", "N1", D(2018, 5, 3)),
    (5, "Cid", "South", "S1", D(2018, 5, 4)),
    (6, "Dee", "South", "S1", D(2018, 6, 5)),
    (7, "Eve", "West", "W1", D(2018, 6, 6)),      # no lines
]
LINES = [
    (1, "Chair", "100.00", "10.00", 1),
    (1, "Shirt", "50.00", "5.00", 1),
    (2, "Phone", "300.00", "-30.00", 2),          # same-day order, the larger one
    (3, "Chair", "100.00", "0.00", 1),
    (4, "Shirt", "450.00", "-5.00", 3),           # Bob ties Ann's first-day revenue
    (5, "Phone", "450.00", "5.00", 1),
    (5, "Shirt", "0.00", "0.00", 1),
    (6, "Chair", "0.00", "0.00", 1),              # a month can sum to 0 revenue lines
]
SUBCATS = [("Chair", "Furniture"), ("Shirt", "Clothing"), ("Phone", "Electronics")]
TARGETS = [(D(2018, 4, 1), "Furniture", "90.00"), (D(2018, 7, 1), "Clothing", "10.00")]


@pytest.fixture(scope="module")
def star(spark):
    return make_star(spark, CUSTOMERS, ORDERS, LINES, SUBCATS, TARGETS)


def test_line_less_order_and_grains(star):
    os = views.order_summary(star)
    assert os.count() == 6                                   # order 7 has no lines
    sc = {r.state: r.orders for r in geo_time.state_scorecard(star).collect()}
    assert "West" not in sc                                  # no line revenue in West
    sp = {r.state: r.orders for r in views.state_performance(star).collect()}
    assert sp == {"North": 4, "South": 2}


def test_ties_rank_and_row_number(star):
    top = customers.top_customers(star, k=5).collect()
    # Ann 550 + 100 = 650 ... Bob 450, Cid 450 tie: same RANK, distinct positions
    ranks = {r.customer_name: r.revenue_rank for r in top}
    assert ranks["Bob"] == ranks["Cid"]
    per_state = customers.top3_per_state(star, k=1).collect()
    north = [r.customer_name for r in per_state if r.state == "North"]
    assert north == ["Ann"]


def test_same_day_orders_sequence_and_first_value(star):
    seq = {r.order_sequence: r for r in customers.order_sequence(star).collect()}
    # Ann is the only repeat customer: orders 1, 2 (same day), 3
    assert seq[1].orders_at_this_sequence == 1 and float(seq[1].avg_order_value) == 150.0
    assert float(seq[2].avg_order_value) == 300.0            # order id breaks the date tie
    assert float(seq[2].avg_days_to_next_order) == 60.0
    assert seq[1].avg_change_vs_previous is None
    fv = customers.first_vs_latest(star).collect()
    assert len(fv) == 1 and fv[0].spend_trend == "Declining (>20% down)"
    assert float(fv[0].avg_first_order) == 300.0             # max of the two first-day orders


def test_zero_prior_revenue_gives_null_growth(star, spark):
    extra = make_star(spark, CUSTOMERS,
                      ORDERS + [(8, "Dee", "South", "S1", D(2018, 7, 9))],
                      [ln for ln in LINES if ln[0] != 3 and ln[0] != 6] +
                      [(6, "Chair", "0.00", "0.00", 1), (8, "Chair", "40.00", "4.00", 1)],
                      SUBCATS, TARGETS)
    g = {r.month_start: r for r in geo_time.monthly_growth(extra).collect()}
    assert float(g[D(2018, 6, 1)].revenue) == 0.0
    assert g[D(2018, 7, 1)].mom_growth_pct is None           # previous month revenue is 0
    assert g[D(2018, 4, 1)].mom_growth_pct is None           # first month


def test_targets_left_join(star):
    grid = {(r.target_month, r.category): r for r in views.sales_vs_target(star).collect()}
    assert len(grid) == 2                                    # sales without target drop out
    july = grid[(D(2018, 7, 1), "Clothing")]
    assert float(july.actual_revenue) == 0.0 and july.status == "Miss"
    april = grid[(D(2018, 4, 1), "Furniture")]
    assert april.status == "Hit" and april.achievement_pct == pytest.approx(111.11)
    v12 = validation.val_target_grid_total(star).collect()[0]
    assert v12.result == "FAIL"


def test_targets_and_sales_in_both_directions(star):
    got = {(r.target_month, r.category): (r.coverage, r.target_amount, r.actual_revenue) for r in products_targets.target_coverage(star).collect()}
    assert got[D(2018, 4, 1), "Furniture"] == ("both", Decimal("90.00"), Decimal("100.0000"))
    assert got[D(2018, 7, 1), "Clothing"] == ("target without sales", Decimal("10.00"), None)
    rest = {k for k, v in got.items() if v[0] == "sales without target"}
    assert rest == {(D(2018, 4, 1), "Clothing"), (D(2018, 4, 1), "Electronics"), (D(2018, 5, 1), "Clothing"), (D(2018, 5, 1), "Electronics"),
                    (D(2018, 6, 1), "Furniture")} and len(got) == 7


def test_category_mix_labels(star):
    mix = {r.category_mix: r.categories_in_order
           for r in sales.category_mix(star, ["Electronics", "Clothing", "Furniture"], 1).collect()}
    assert mix["Clothing + Furniture"] == 2
    assert mix["Electronics"] == 1
    assert mix["Electronics + Clothing"] == 2


def test_profit_zero_boundaries(star):
    # Chair: 10 + 0 + 0 = 10 > 0; Shirt 5 - 5 + 0 = 0 (not < 0); Phone -30 + 5 = -25
    q6 = [r.sub_category for r in sales.subcat_counterfactual(star).collect()]
    assert q6 == ["Phone"]
    # South: Cid 5 + 0, Dee 0 -> 5 ; North: 10 + 5 - 30 + 0 - 5 = -20
    q12 = {r.state for r in geo_time.loss_states(star).collect()}
    assert q12 == {"North"}


def test_profit_exactly_zero_is_a_loss_state(spark):
    s = make_star(spark, CUSTOMERS[:1], ORDERS[:1], [(1, "Chair", "10.00", "0.00", 1)],
                  SUBCATS, TARGETS)
    assert [r.state for r in geo_time.loss_states(s).collect()] == ["North"]
    assert sales.subcat_counterfactual(s).count() == 0


def test_running_share_half_way_counts_as_reached(spark):
    # shares 49.995 %, 30.005 %, 20 %: the first customer alone reaches 50 % after rounding
    cust = [("A", "S", "C"), ("B", "S", "C"), ("C", "S", "C")]
    orders = [(1, "A", "S", "C", D(2018, 4, 1)), (2, "B", "S", "C", D(2018, 4, 2)),
              (3, "C", "S", "C", D(2018, 4, 3))]
    lines = [(1, "Chair", "49995.00", "1.00", 1), (2, "Chair", "30005.00", "1.00", 1),
             (3, "Chair", "20000.00", "1.00", 1)]
    s = make_star(spark, cust, orders, lines, SUBCATS, TARGETS)
    r = customers.revenue_concentration(s).collect()[0]
    assert r.customers_for_50pct_revenue == 1
    assert r.customers_for_80pct_revenue == 2
    assert r.pct_of_base_for_half_revenue == pytest.approx(33.3)


def test_fewer_customers_than_rfm_buckets(spark):
    s = make_star(spark, CUSTOMERS[:2], ORDERS[:1] + [ORDERS[3]],
                  [LINES[0], LINES[4]], SUBCATS, TARGETS)
    rfm = {r.customer_name: r for r in views.customer_rfm(s, cuts=(2, 3, 4)).collect()}
    assert rfm["Ann"].m_score == 1 and rfm["Bob"].m_score == 2
    assert {r.r_score for r in rfm.values()} <= {4, 5}


def test_half_trend_missing_half_is_deteriorating(star):
    rows = products_targets.target_half_trend(star).collect()
    clothing = [r for r in rows if r.category == "Clothing"][0]
    # July is in the first fiscal half; no second-half target -> not improving
    assert clothing.h1_achievement_pct == 0.0 and clothing.h2_achievement_pct is None
    assert clothing.direction == "Deteriorating"


def test_validation_detects_seeded_faults(spark, star):
    ok = {r.check_id: r.result for r in [
        validation.val_revenue_grains(star).collect()[0],
        validation.val_referential(star).collect()[0],
        validation.val_rfm_range(star).collect()[0],
        validation.val_variance_rows(star).collect()[0]]}
    assert ok["V1"] == "PASS" and ok["V10"] == "PASS" and ok["V13"] == "PASS"
    assert ok["V16"] == "FAIL"                               # order 7 has no lines
    # seed an orphan line: line grain no longer reconciles with order grain
    orphan = spark.createDataFrame([(99, "Chair", Decimal("5.00"), Decimal("1.00"), 1)],
                                   star.fact_order_lines.schema)
    broken = Star(star.dim_customer, star.dim_sub_category, star.fact_orders,
                  star.fact_order_lines.unionByName(orphan), star.fact_sales_target,
                  star.orders_wide)
    assert validation.val_revenue_grains(broken).collect()[0].result == "FAIL"
    assert validation.val_profit_grains(broken).collect()[0].result == "FAIL"
    assert validation.val_aov_two_ways(broken).collect()[0].result == "FAIL"
    assert validation.val_running_total(broken).collect()[0].result == "FAIL"
