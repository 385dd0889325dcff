"""DuckDB SQL for the validation suite (V1-V19) and its sink (S8)."""

from __future__ import annotations

from tillroll.oracle import pct, per
from tillroll.oracle_quality import STAGING


def _txt(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _dec(x: str, scale: int = 2) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,{scale})) AS VARCHAR)"


def _check(cid: str, name: str, cond: str, detail: str) -> str:
    return (f"SELECT '{cid}' AS check_id, '{name}' AS check_name, "
            f"CASE WHEN {cond} THEN 'PASS' ELSE 'FAIL' END AS result, {detail} AS detail")


LINE_REV = "(SELECT SUM(amount) FROM fol)"
LINE_PROFIT = "(SELECT SUM(profit) FROM fol)"
MONTHS = ("(SELECT month_start, month_label, revenue, ROW_NUMBER() OVER (ORDER BY month_start) AS rn, "
          f"{pct('revenue - LAG(revenue) OVER (ORDER BY month_start)', 'LAG(revenue) OVER (ORDER BY month_start)')} AS mom, "
          "revenue - LAG(revenue) OVER (ORDER BY month_start) AS growth FROM ms)")


def check_bodies() -> dict[str, str]:
    grains = [LINE_REV, "(SELECT SUM(order_revenue) FROM os)", "(SELECT SUM(total_revenue) FROM cm)",
              "(SELECT SUM(revenue) FROM sp)", "(SELECT SUM(revenue) FROM ms)",
              "(SELECT SUM(revenue) FROM scp)"]
    pgrains = [LINE_PROFIT, "(SELECT SUM(order_profit) FROM os)", "(SELECT SUM(total_profit) FROM cm)",
               "(SELECT SUM(profit) FROM sp)"]
    eq = lambda xs: " AND ".join(f"{a} = {b}" for a, b in zip(xs, xs[1:]))
    avg_m = f"(SELECT {per('SUM(order_revenue)', 'COUNT(*)')} FROM os)"
    ratio_m = f"(SELECT {per('SUM(amount)', 'COUNT(DISTINCT order_id)')} FROM fol)"
    orders, people = "(SELECT COUNT(*) FROM fo)", "(SELECT COUNT(*) FROM dcu)"
    correct = f"(SELECT {pct('SUM(profit)', 'SUM(amount)')} FROM fol)"
    at_order = f"(SELECT {pct('SUM(order_profit)', 'SUM(order_revenue)')} FROM os)"
    naive = "(SELECT ROUND(AVG(100e0 * CAST(profit AS DOUBLE) / NULLIF(CAST(amount AS DOUBLE), 0)), 2) FROM fol)"
    cur = f"(SELECT revenue FROM {MONTHS} m WHERE rn = 8)"
    prev = f"(SELECT revenue FROM {MONTHS} m WHERE rn = 7)"
    hand = f"({pct(f'{cur} - {prev}', prev)})"
    query = f"(SELECT mom FROM {MONTHS} m WHERE rn = 8)"
    hi = f"(SELECT {per('SUM(days_since_last_order)', 'COUNT(*)', 0, 0)} FROM rfm WHERE r_score = 5)"
    lo = f"(SELECT {per('SUM(days_since_last_order)', 'COUNT(*)', 0, 0)} FROM rfm WHERE r_score = 1)"
    grid = "(SELECT SUM(actual_revenue) FROM svt)"
    top = ("(SELECT state, ROW_NUMBER() OVER (PARTITION BY state ORDER BY total_revenue DESC, "
           "customer_name, city) AS rn FROM cm)")
    empty = "(SELECT COUNT(*) FROM fo WHERE NOT EXISTS (SELECT 1 FROM fol l WHERE l.order_id = fo.order_id))"
    orphan = "(SELECT COUNT(*) FROM fol l WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.order_id = l.order_id))"
    loss = ("(SELECT COUNT(*) FROM raw_d WHERE abs(TRY_CAST(profit AS DECIMAL(18,4))) > "
            "TRY_CAST(amount AS DECIMAL(18,4)))")
    impossible = ("(SELECT COUNT(*) FROM raw_o o WHERE trim(city) IN (SELECT city FROM geo) AND NOT EXISTS "
                  "(SELECT 1 FROM geo g WHERE g.city = trim(o.city) AND g.state = trim(o.state)))")
    shared = ("(SELECT COUNT(*) FROM raw_o WHERE trim(city) IN "
              "(SELECT city FROM geo GROUP BY city HAVING COUNT(*) > 1))")
    padded = "(SELECT COUNT(*) FROM raw_o WHERE state <> trim(state))"
    return {
        "val_revenue_grains": _check("V1", "Revenue identical at all six grains", eq(grains),
                                     f"'all grains = ' || {_txt(LINE_REV)}"),
        "val_profit_grains": _check("V2", "Profit identical at all grains", eq(pgrains),
                                    f"'all grains = ' || {_txt(LINE_PROFIT)}"),
        "val_aov_two_ways": _check("V3", "AOV consistent across two methods", f"{avg_m} = {ratio_m}",
                                   f"'avg method = ' || {_dec(avg_m)} || ', ratio method = ' || {_dec(ratio_m)}"),
        "val_counts": _check(
            "V4", "Order/customer counts not inflated by join",
            f"(SELECT COUNT(*) FROM os) = {orders} AND (SELECT COUNT(*) FROM cm) = {people} AND "
            f"(SELECT SUM(orders) FROM sp) = {orders} AND (SELECT SUM(customers) FROM sp) = {people} AND "
            f"(SELECT SUM(orders) FROM ms) = {orders}",
            f"{_txt(orders)} || ' orders / ' || {_txt(people)} || ' customers at every grain'"),
        "val_margin_ratio": _check(
            "V5", "Margin uses ratio of totals, not mean of ratios", f"{correct} = {at_order}",
            f"'correct = ' || {_dec(correct)} || '%, naive row-average = ' || {_dec(naive)} || '%'"),
        "val_running_total": _check(
            "V6", "Cumulative revenue closes on grand total",
            "(SELECT MAX(r) FROM (SELECT SUM(revenue) OVER (ORDER BY month_start ROWS BETWEEN "
            f"UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM ms) x) = {LINE_REV}",
            "'final cumulative row = total revenue'"),
        "val_mom_hand": _check("V7", "MoM growth matches hand calculation", f"{hand} = {query}",
                               f"'hand = ' || {_dec(hand)} || '%, query = ' || {_dec(query)} || '%'"),
        "val_first_mom_null": _check(
            "V8", "First month MoM growth is NULL, not zero",
            f"(SELECT growth FROM {MONTHS} m WHERE rn = 1) IS NULL",
            f"(SELECT month_label FROM {MONTHS} m WHERE rn = 1) || ' has no prior month'"),
        "val_rfm_partition": _check(
            "V9", "RFM segments partition the customer base",
            f"(SELECT COUNT(*) FROM rfm) = (SELECT COUNT(*) FROM cm) AND "
            f"(SELECT SUM(total_revenue) FROM rfm) = {LINE_REV} AND "
            "NOT EXISTS (SELECT 1 FROM rfm WHERE rfm_segment IS NULL)",
            "CAST((SELECT COUNT(DISTINCT rfm_segment) FROM rfm) AS VARCHAR) || ' segments covering ' || "
            "CAST((SELECT COUNT(*) FROM cm) AS VARCHAR) || ' customers, no NULLs'"),
        "val_rfm_range": _check(
            "V10", "RFM scores within 1-5",
            "NOT EXISTS (SELECT 1 FROM rfm WHERE r_score NOT BETWEEN 1 AND 5 OR f_score NOT BETWEEN 1 AND 5 "
            "OR m_score NOT BETWEEN 1 AND 5)", "'r, f and m all in [1,5]'"),
        "val_recency_direction": _check(
            "V11", "Recency inverted correctly (recent = high score)", f"{hi} < {lo}",
            f"'avg days: score5 = ' || {_dec(hi, 0)} || ', score1 = ' || {_dec(lo, 0)}"),
        "val_target_grid_total": _check(
            "V12", "Target grid accounts for all revenue", f"{grid} = {LINE_REV}",
            f"'grid = ' || {_txt(grid)} || ', total = ' || {_txt(LINE_REV)}"),
        "val_variance_rows": _check(
            "V13", "Variance = actual - target on every row",
            "NOT EXISTS (SELECT 1 FROM svt WHERE variance <> actual_revenue - target_amount)",
            "'checked across all ' || CAST((SELECT COUNT(*) FROM svt) AS VARCHAR) || ' cells'"),
        "val_shares_sum": _check(
            "V14", "Revenue shares sum to 100%",
            f"(SELECT ROUND(SUM(100e0 * CAST(revenue AS DOUBLE) / CAST({LINE_REV} AS DOUBLE)), 2) "
            "FROM scp) = 100.0",
            "CAST((SELECT COUNT(*) FROM scp) AS VARCHAR) || ' sub-categories'"),
        "val_topn_bound": _check(
            "V15", "Top-3-per-state returns at most 3 per state",
            f"COALESCE((SELECT MAX(n) FROM (SELECT state, COUNT(*) AS n FROM {top} r WHERE rn <= 3 "
            "GROUP BY state) s), 0) <= 3",
            "'across all ' || CAST((SELECT COUNT(DISTINCT state) FROM cm) AS VARCHAR) || ' states'"),
        "val_referential": _check(
            "V16", "Referential integrity holds both directions", f"{empty} = 0 AND {orphan} = 0",
            f"{_txt(orphan)} || ' orphan lines, ' || {_txt(empty)} || ' empty orders'"),
        "val_exception_count": _check(
            "V17", "Data-quality exceptions captured",
            f"(SELECT COUNT(*) FROM dq_log) = {loss} + {impossible} + {shared} + {padded}",
            "CAST((SELECT COUNT(*) FROM dq_log) AS VARCHAR) || ' rows across ' || "
            "CAST((SELECT COUNT(DISTINCT check_name) FROM dq_log) AS VARCHAR) || ' checks'"),
    }


def validation_sql() -> dict[str, str]:
    bodies = check_bodies()
    union = " UNION ALL ".join(f"({b})" for b in bodies.values())
    out = {k: STAGING + b for k, b in bodies.items()}
    out["val_results"] = STAGING + union
    out["sink_validation"] = STAGING + union
    out["val_verdict"] = STAGING + f"""
, res AS ({union})
SELECT COUNT(*) AS checks_run, COUNT(*) FILTER (WHERE result = 'PASS') AS passed,
       COUNT(*) FILTER (WHERE result = 'FAIL') AS failed,
       CASE WHEN COUNT(*) FILTER (WHERE result = 'FAIL') = 0 THEN 'ALL CHECKS PASSED'
            ELSE 'VALIDATION FAILED - DO NOT TRUST DOWNSTREAM RESULTS' END AS verdict
FROM res"""
    return out
