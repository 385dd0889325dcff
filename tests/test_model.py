"""The star built through the text staging layer (the original load path)
answers exactly like the star built straight from the typed tables, and the
materialised (bucketed) model answers like the lazy one."""

from __future__ import annotations

from pyspark.sql import functions as F

from given_tables import SF_SMALL
from tillroll.plans import cleaning, geo_time, sales, views
from tillroll.registry import present
from tillroll.sources import sinks
from tillroll.sources.staging import staging_from_star
from tillroll.sources.tables import build_star


def _same(a, b):
    a, b = present(a), present(b)
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_staging_path_equals_direct_path(spark):
    direct = build_star(spark, SF_SMALL)
    staged = cleaning.star_from_staging(staging_from_star(build_star(spark, SF_SMALL)))
    for job in (sales.kpi_summary, sales.category_scorecard, geo_time.state_scorecard,
                views.sales_vs_target):
        _same(job(direct), job(staged))


def test_materialised_model_equals_lazy_model(spark):
    lazy = build_star(spark, SF_SMALL)
    stored = sinks.materialize_star(lazy, sinks.shared_dir(spark, "test-model"), 4, "t_model")
    for job in (views.order_summary, views.customer_metrics, geo_time.monthly_growth):
        _same(job(lazy), job(stored))
    # the bucketed facts join on order id without an exchange on the lines side
    plan = stored.fact_order_lines.groupBy("order_id").agg(F.sum("amount"))._jdf \
        .queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_a_period_reads_its_months_only(spark):
    lazy = build_star(spark, SF_SMALL)
    stored = sinks.materialize_star(lazy, sinks.shared_dir(spark, "dated"), 4, "t_dated")
    assert stored.dated_orders.schema["month_start"].dataType.typeName() == "date"
    period = ("1997-04-01", "1997-06-20")
    _same(geo_time.monthly_growth(lazy, *period), geo_time.monthly_growth(stored, *period))
    _same(views.order_summary(lazy, True), views.order_summary(stored, True))
    files = views.order_summary(stored, False, *period).select(F.input_file_name().alias("f")).distinct().collect()
    months = {r.f.split("month_start=")[1].split("/")[0] for r in files}
    assert months == {"1997-04-01", "1997-05-01", "1997-06-01"}
    plan = geo_time.monthly_growth(stored, *period)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_start" in plan and "Join" not in plan
    # a table of months, filtered by something else, prunes the facts at run time
    calendar = spark.createDataFrame([(f"199{y}-0{m}-01", f"FY{y}") for y in range(5, 9) for m in range(4, 7)], "d string, fy string").select(
        F.to_date("d").alias("month_start"), "fy")
    picked = views.order_summary(stored).join(F.broadcast(calendar.where("fy = 'FY7'")), "month_start")
    assert "dynamicpruning" in picked._jdf.queryExecution().executedPlan().toString().lower()
    want = views.order_summary(lazy).where("month_start between '1997-04-01' and '1997-06-01'").count()
    assert picked.count() == want > 0
