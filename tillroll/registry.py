"""Registry of every job: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

``present`` is the single output convention: exact decimals become DOUBLE
once, small integer types become BIGINT, and surrogate hash keys are not
part of any compared output (natural keys are).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import oracle, oracle_quality, oracle_validation
from tillroll.plans import (audit, cleaning, customers, geo_time, products_targets, quality, sales,
                            validation, views)
from tillroll.sources import sinks
from tillroll.sources.publish import ModelStore
from tillroll.sources.staging import (ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS, RAW_TARGET_COLUMNS,
                                      TARGET_CSV_HEADER, Staging, read_csv_lines, read_text_csv, staging_from_star,
                                      write_broken_csv, write_text_csv)
from tillroll.sources.tables import geography_reference

# Fixed values for the driver tables: the product categories (last word of the part
# name) in label order, for the SQL's columns, and the category singled out by Q16 / Q38.
CATEGORIES = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
FOCUS_CATEGORY = "gear"
MIN_CITY_ORDERS = 10
MIN_MIX_ORDERS = 10
# Q12 lists states with at most this share of the mean state's profit (0: losses only).
LOSS_BOUND = 1.0
# Fiscal years (April-March) spanning the driver tables' order dates: the
# window the load assertion A6 checks every parsed date against.
PERIOD_START, PERIOD_END = "1994-04-01", "2002-03-31"
# Q13 for one period: two months and a part of a third.
PERIOD_OF_GROWTH = ("1997-04-01", "1997-06-20")


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


_MODELS: dict[tuple[str, str], object] = {}


def published(spark: SparkSession, sf_dir: str):
    """(star, manifest) of the analysis model: loaded, audited and published once for the
    state of the driver tables, and opened by every application after that - the
    load-once / query-many shape of the original pipeline."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = sinks.published_model(spark, sf_dir, PERIOD_START, PERIOD_END)
    return _MODELS[key]


def model(spark: SparkSession, sf_dir: str):
    """The modelled layer for ``sf_dir``: what every analysis job reads."""
    return published(spark, sf_dir)[0]


def staging(spark: SparkSession, sf_dir: str) -> Staging:
    """The text staging tables for ``sf_dir``, rendered once per application
    (from the stored model, so the large driver tables are not joined a second
    time) and stored as text columns in the shared checkpoint folder, as the
    original load stores its raw files before profiling them."""
    key = (spark.sparkContext.applicationId, "staging:" + sf_dir)
    if key not in _MODELS:
        path = sinks.shared_dir(spark, "staging")
        raw = staging_from_star(model(spark, sf_dir), defects=True)

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").options(**sinks.STORED).parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")
        _MODELS[key] = Staging(keep(raw.raw_orders, "raw_orders"),
                               keep(raw.raw_order_details, "raw_order_details"),
                               keep(raw.raw_sales_target, "raw_sales_target"))
    return _MODELS[key]


def _star_job(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(model(spark, sf_dir)))
    run.__name__ = getattr(fn, "__name__", "job")
    run.__doc__ = fn.__doc__
    return run


def _order_summary_named(star):
    return views.order_summary(star, with_customer=True).select(
        "order_id", "order_date", "month_start", "customer_name", "state", "city",
        "line_count", "order_revenue", "order_profit", "order_quantity")


def _without_key(fn):
    def run(star):
        return fn(star).drop("customer_id")
    run.__doc__ = fn.__doc__
    return run


def view_jobs() -> dict[str, Callable]:
    return {
        "v_order_summary": _star_job(_order_summary_named),
        "v_customer_metrics": _star_job(_without_key(views.customer_metrics)),
        "v_monthly_sales": _star_job(views.monthly_sales),
        "v_sub_category_performance": _star_job(views.sub_category_performance),
        "v_state_performance": _star_job(views.state_performance),
        "v_customer_rfm": _star_job(_without_key(views.customer_rfm)),
        "v_sales_vs_target": _star_job(views.sales_vs_target),
    }


def categories(star) -> list[str]:
    """The categories sold, in label order: from the stored dimension (a handful of rows)."""
    return [r.category for r in star.dim_sub_category.select("category").where("category IS NOT NULL")
            .distinct().orderBy("category").collect()]


def question_jobs() -> dict[str, Callable]:
    focus = FOCUS_CATEGORY
    return {
        "kpi_summary": _star_job(sales.kpi_summary),
        "reconcile_grains": _star_job(sales.reconcile_grains),
        "category_scorecard": _star_job(sales.category_scorecard),
        "subcat_loss_share": _star_job(sales.subcat_loss_share),
        "subcat_quadrant": _star_job(sales.subcat_quadrant),
        "subcat_counterfactual": _star_job(sales.subcat_counterfactual),
        "subcat_pareto": _star_job(sales.subcat_pareto),
        "subcat_line_value": _star_job(sales.subcat_line_value),
        "state_scorecard": _star_job(geo_time.state_scorecard),
        "state_market_class": _star_job(geo_time.state_market_class),
        "city_performance": _star_job(lambda s: geo_time.city_performance(s, MIN_CITY_ORDERS)),
        "loss_states": _star_job(lambda s: geo_time.loss_states(s, LOSS_BOUND)),
        "monthly_growth": _star_job(geo_time.monthly_growth),
        "monthly_growth_period": _star_job(lambda s: geo_time.monthly_growth(s, *PERIOD_OF_GROWTH)),
        "fiscal_quarter": _star_job(geo_time.fiscal_quarter),
        "day_of_week": _star_job(geo_time.day_of_week),
        "category_month_pivot": _star_job(lambda s: geo_time.category_month_pivot(s, categories(s), focus)),
        "one_time_vs_repeat": _star_job(customers.one_time_vs_repeat),
        "frequency_distribution": _star_job(customers.frequency_distribution),
        "revenue_concentration": _star_job(customers.revenue_concentration),
        "top_customers": _star_job(customers.top_customers),
        "unprofitable_big_spenders": _star_job(customers.unprofitable_big_spenders),
        "above_average_group": _star_job(customers.above_average_group),
        "ntile_artefact": _star_job(customers.ntile_artefact),
        "rfm_scorecard": _star_job(customers.rfm_scorecard),
        "at_risk_list": _star_job(customers.at_risk_list),
        "order_sequence": _star_job(customers.order_sequence),
        "first_vs_latest": _star_job(customers.first_vs_latest),
        "top3_per_state": _star_job(customers.top3_per_state),
        "top3_subcat_ranks": _star_job(products_targets.top3_subcat_ranks),
        "margin_quartiles": _star_job(products_targets.margin_quartiles),
        "target_by_category": _star_job(products_targets.target_by_category),
        "target_by_month": _star_job(products_targets.target_by_month),
        "target_grid": _star_job(products_targets.target_grid),
        "target_half_trend": _star_job(products_targets.target_half_trend),
        "target_coverage": _star_job(products_targets.target_coverage),
        "target_hit_vs_profit": _star_job(products_targets.target_hit_vs_profit),
        "order_size_buckets": _star_job(sales.order_size_buckets),
        "category_mix": _star_job(lambda s: sales.category_mix(s, categories(s), MIN_MIX_ORDERS)),
        "contains_category_effect": _star_job(lambda s: sales.contains_category_effect(s, focus)),
    }


def _stg_job(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(staging(spark, sf_dir)))
    run.__name__ = getattr(fn, "__name__", "job")
    run.__doc__ = fn.__doc__
    return run


def _geo_job(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = quality.city_state_rules(geography_reference(spark, sf_dir))
        return present(fn(staging(spark, sf_dir), rules))
    run.__doc__ = fn.__doc__
    return run


def _csv_roundtrip(table: str, header, names) -> Callable[[SparkSession, str], DataFrame]:
    """S1/S2 - write the staged file as a headed CSV, read it back as text."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stg = staging(spark, sf_dir)
        path = sinks.shared_dir(spark, table)
        write_text_csv(getattr(stg, table), path, header)
        return read_text_csv(spark, path, header, names)
    return run


def _malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 - lines of the order file with too few or too many fields, listed whole, and the number of good rows by state."""
    path = sinks.shared_dir(spark, "broken_orders")
    write_broken_csv(staging(spark, sf_dir).raw_orders, path)
    rows, malformed = read_csv_lines(spark, path, ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS, header=False)
    return malformed.select("line", F.lit(1).cast("long").alias("lines")).unionByName(
        rows.groupBy(F.concat(F.lit("rows of "), "state").alias("line")).agg(F.count(F.lit(1)).alias("lines")))


def _sink_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 - populate the model from staging; its rows, read back."""
    return sinks.model_rows(loaded(spark, sf_dir).star)


def _full_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 - a load over an earlier one with other rows; the rows of the published version, read back."""
    stg = staging(spark, sf_dir)
    store = ModelStore(spark, sinks.shared_dir(spark, "model"))
    odd = F.pmod(F.col("order_id").cast("long"), F.lit(2)) == 1
    earlier = Staging(stg.raw_orders.filter(odd).withColumn("city", F.lit("OLD")),
                      stg.raw_order_details.filter(odd), stg.raw_sales_target)
    sinks.load_staged(store, earlier, PERIOD_START, PERIOD_END)
    sinks.load_staged(store, stg, PERIOD_START, PERIOD_END)
    return sinks.model_rows(sinks.read_loaded(spark, store.current()).star)


def _audit_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A9 on the published analysis model, judged again from storage."""
    return audit.audit_model(audit.source_totals(spark, sf_dir), model(spark, sf_dir), PERIOD_START, PERIOD_END)


def _model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the published analysis model with the row counts that its manifest records."""
    tables = published(spark, sf_dir)[1].tables
    return spark.createDataFrame([(name, t["rows"]) for name, t in tables.items()], "table_name string, row_count long")


def _sink_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 - the four exception feeds appended into one written log."""
    rules = quality.city_state_rules(geography_reference(spark, sf_dir))
    log = quality.exception_log(staging(spark, sf_dir), rules)
    return sinks.write_log(log, sinks.shared_dir(spark, "dq_exceptions"))


def _log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 - a log of two runs of which the first is repeated with other rows: rows by run and check."""
    rules = quality.city_state_rules(geography_reference(spark, sf_dir))
    log = quality.exception_log(staging(spark, sf_dir), rules)
    path = sinks.shared_dir(spark, "dq_exceptions")
    sinks.write_log(log.where("severity = 'INFO'"), path, "2018-04-01")
    sinks.write_log(log.where("severity <> 'WARN'"), path, "2018-04-02")
    sinks.write_log(log, path, "2018-04-01")
    return sinks.read_log(spark, path, log.schema).groupBy("run_id", "check_name", "severity").agg(F.count(F.lit(1)).alias("rows_logged"))


def _breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.city_state_rules(geography_reference(spark, sf_dir))
    return quality.exc_breakdown(quality.exception_log(staging(spark, sf_dir), rules))


def _named_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 - the seven views registered by name and queried with SQL."""
    star = model(spark, sf_dir)
    named = {
        "v_order_summary": views.order_summary(star),
        "v_customer_metrics": views.customer_metrics(star),
        "v_monthly_sales": views.monthly_sales(star),
        "v_sub_category_performance": views.sub_category_performance(star),
        "v_state_performance": views.state_performance(star),
        "v_customer_rfm": views.customer_rfm(star),
        "v_sales_vs_target": views.sales_vs_target(star),
    }
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{name}' AS view_name, COUNT(*) AS row_count FROM {name}" for name in named))


def _drop(fn, *cols):
    def run(stg):
        return fn(stg).drop(*cols)
    run.__doc__ = fn.__doc__
    return run


def loaded(spark: SparkSession, sf_dir: str) -> sinks.Loaded:
    """The model loaded from staging and published, once per application: what A1-A9 judge one by one."""
    key = (spark.sparkContext.applicationId, "loaded:" + sf_dir)
    if key not in _MODELS:
        store = ModelStore(spark, sinks.shared_dir(spark, "model"))
        _MODELS[key] = sinks.read_loaded(spark, sinks.load_staged(store, staging(spark, sf_dir), PERIOD_START, PERIOD_END))
    return _MODELS[key]


def accepted(spark: SparkSession, sf_dir: str) -> Staging:
    """The staged rows that the load takes."""
    key = (spark.sparkContext.applicationId, "accepted:" + sf_dir)
    if key not in _MODELS:
        _MODELS[key] = cleaning.accepted(cleaning.judged(staging(spark, sf_dir)))
    return _MODELS[key]


def _load_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 - every staged row that the load rejects, in full, with its reasons."""
    return loaded(spark, sf_dir).quarantine


def _load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 - rejected rows by table and reason."""
    return cleaning.reject_counts(loaded(spark, sf_dir).quarantine)


def _assert_job(fn: Callable, *args) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(accepted(spark, sf_dir), *args, model=loaded(spark, sf_dir).star))
    run.__doc__ = fn.__doc__
    return run


def _orders_with_identity(stg, collation=None):
    """T3 with the customer it is linked to: the key joined back to the dimension."""
    people = cleaning.build_dim_customer(stg, collation)
    return cleaning.build_fact_orders(stg, collation).join(people, "customer_id", "left").select(
        "order_id", "order_date", "customer_name", "state", "city")


def staging_jobs() -> dict[str, Callable]:
    q, c = quality, cleaning
    return {
        "stage_raw_orders": _stg_job(lambda s: s.raw_orders),
        "stage_raw_order_details": _stg_job(lambda s: s.raw_order_details),
        "stage_raw_sales_target": _stg_job(lambda s: s.raw_sales_target),
        "src_orders_csv": _csv_roundtrip("raw_orders", ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS),
        "src_malformed_lines": _malformed_lines,
        "src_target_csv": _csv_roundtrip("raw_sales_target", TARGET_CSV_HEADER, RAW_TARGET_COLUMNS),
        "sink_model": _sink_model,
        "full_reload": _full_reload,
        "audit_model": _audit_model,
        "model_tables": _model_tables,
        "load_quarantine": _load_quarantine,
        "load_rejects": _load_rejects,
        "sink_exceptions": _sink_exceptions,
        "named_views": _named_views,
        "dq_row_counts": _stg_job(q.dq_row_counts),
        "dq_missing_scan": _stg_job(q.dq_missing_scan),
        "dq_pk_unique": _stg_job(q.dq_pk_unique),
        "dq_full_duplicates": _stg_job(q.dq_full_duplicates),
        "dq_candidate_key": _stg_job(q.dq_candidate_key),
        "dq_referential": _stg_job(q.dq_referential),
        "dq_whitespace": _stg_job(q.dq_whitespace),
        "dq_case_variants": _stg_job(q.dq_case_variants),
        "dq_case_variants_any_case": _stg_job(lambda s: q.dq_case_variants(s, "state", c.ANY_CASE)),
        "build_dim_customer_any_case": _stg_job(_drop(lambda s: c.build_dim_customer(s, c.ANY_CASE), "customer_id")),
        "build_fact_orders_any_case": _stg_job(lambda s: _orders_with_identity(s, c.ANY_CASE)),
        "assert_identity_unique_any_case": _stg_job(lambda s: q.assert_identity_unique(s, collation=c.ANY_CASE)),
        "sink_exceptions_by_run": _log_runs,
        "dq_date_format_proof": _stg_job(q.dq_date_format_proof),
        "dq_numeric_validity": _stg_job(q.dq_numeric_validity),
        "dq_loss_exceeds_revenue": _stg_job(q.dq_loss_exceeds_revenue),
        "dq_city_multi_state": _stg_job(q.dq_city_multi_state),
        "dq_identity_ambiguity": _stg_job(q.dq_identity_ambiguity),
        "dq_target_coverage": _stg_job(q.dq_target_coverage),
        "dq_functional_dependency": _stg_job(q.dq_functional_dependency),
        "dq_constraints": _stg_job(q.dq_constraints),
        "exc_loss_exceeds_revenue": _stg_job(q.exc_loss_exceeds_revenue),
        "exc_impossible_geo": _geo_job(q.exc_impossible_geo),
        "exc_shared_geo": _geo_job(q.exc_shared_geo),
        "exc_untrimmed": _stg_job(q.exc_untrimmed),
        "exc_breakdown": _breakdown,
        "build_dim_sub_category": _stg_job(c.build_dim_sub_category),
        "build_dim_customer": _stg_job(_drop(c.build_dim_customer, "customer_id")),
        "build_fact_orders": _stg_job(_orders_with_identity),
        "build_fact_lines": _stg_job(c.build_fact_lines),
        "build_fact_target": _stg_job(c.build_fact_target),
        "assert_row_counts": _assert_job(q.assert_row_counts),
        "assert_revenue_preserved": _assert_job(q.assert_revenue_preserved),
        "assert_profit_preserved": _assert_job(q.assert_profit_preserved),
        "assert_quantity_preserved": _assert_job(q.assert_quantity_preserved),
        "assert_no_fanout": _assert_job(q.assert_no_fanout),
        "assert_dates_in_range": _assert_job(q.assert_dates_in_range, PERIOD_START, PERIOD_END),
        "assert_target_categories": _assert_job(q.assert_target_categories),
        "assert_identity_unique": _assert_job(q.assert_identity_unique),
        "assert_no_untrimmed": _assert_job(q.assert_no_untrimmed),
    }


def _val_job(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(model(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    return run


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.city_state_rules(geography_reference(spark, sf_dir))
    return validation.validation_results(model(spark, sf_dir), staging(spark, sf_dir),
                                         rules)


def _exception_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.city_state_rules(geography_reference(spark, sf_dir))
    return validation.val_exception_count(model(spark, sf_dir), staging(spark, sf_dir),
                                          rules)


def _sink_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 - all check rows appended into one written results table."""
    return sinks.write_log(_results(spark, sf_dir), sinks.shared_dir(spark, "validation_results"))


def validation_jobs() -> dict[str, Callable]:
    v = validation
    return {
        "val_revenue_grains": _val_job(v.val_revenue_grains),
        "val_profit_grains": _val_job(v.val_profit_grains),
        "val_aov_two_ways": _val_job(v.val_aov_two_ways),
        "val_counts": _val_job(v.val_counts),
        "val_margin_ratio": _val_job(v.val_margin_ratio),
        "val_running_total": _val_job(v.val_running_total),
        "val_mom_hand": _val_job(v.val_mom_hand),
        "val_first_mom_null": _val_job(v.val_first_mom_null),
        "val_rfm_partition": _val_job(v.val_rfm_partition),
        "val_rfm_range": _val_job(v.val_rfm_range),
        "val_recency_direction": _val_job(v.val_recency_direction),
        "val_target_grid_total": _val_job(v.val_target_grid_total),
        "val_variance_rows": _val_job(v.val_variance_rows),
        "val_shares_sum": _val_job(v.val_shares_sum),
        "val_topn_bound": _val_job(v.val_topn_bound),
        "val_referential": _val_job(v.val_referential),
        "val_exception_count": _exception_count,
        "val_verdict": lambda spark, sf: validation.validation_verdict(_results(spark, sf)),
        "val_results": _results,
        "sink_validation": _sink_validation,
    }


def all_jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    jobs: dict[str, Callable] = {}
    jobs.update(view_jobs())
    jobs.update(question_jobs())
    jobs.update(staging_jobs())
    jobs.update(validation_jobs())
    return jobs


def all_oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql.update(oracle.views_sql())
    sql.update(oracle.questions_sql(list(CATEGORIES), FOCUS_CATEGORY, MIN_CITY_ORDERS,
                                    MIN_MIX_ORDERS, LOSS_BOUND, PERIOD_OF_GROWTH))
    sql.update(oracle_quality.staging_sql(PERIOD_START, PERIOD_END))
    sql.update(oracle_validation.validation_sql())
    return sql
