"""Registered queries: reconciliation, read queries and report views over the marts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.model import MART_TABLES
from tidemark.plans import reconcile, refresh, serve, views
from tidemark.registry.core_sql import dates_as_text, over_core
from tidemark.registry.marts import stored_marts
from tidemark.registry.portable import portable
from tidemark.session import configure
from tidemark.sources.tables import core_from_tables, table

def _over_marts(plan):
    """A query of (core, stored marts)."""
    def run(spark, directory):
        core = core_from_tables(configure(spark), directory)
        return portable(plan(core, stored_marts(core)))
    return run


def _runs(spark, directory):
    """A refresh log derived from the event stream: an event type is a run."""
    events = table(spark, directory, "events")
    return events.groupBy("event_type").agg(F.min("ts").alias("started_at"), F.max_by(
        F.expr("case when event_id % 3 = 0 then 'failed' else 'completed' end"), "event_id")
        .alias("status")).withColumnRenamed("event_type", "run_id")


_RUNS_SQL = """(select event_type as run_id, min(ts) as started_at, arg_max(case when
    event_id % 3 = 0 then 'failed' else 'completed' end, event_id) as status
    from events group by event_type)"""


# --- checks -----------------------------------------------------------------------------------

def _check_sql(name, expected, actual, code="null", null_safe=False, extra="false"):
    same = "e is not distinct from a" if null_safe else "coalesce(e = a, false)"
    return over_core(f"""
        select cast({code} as varchar) as code, '{name}' as check_name,
               cast(e as double) as expected, cast(a as double) as actual,
               {same} or {extra} as valid
        from (select round(cast(({expected}) as decimal(38,2)), 2) as e,
                     round(cast(({actual}) as decimal(38,2)), 2) as a)""")


_LINE_REVENUE = "select sum(quantity * unit_price)::decimal(38,2) / 100 from sales_order_lines"
_MONTH = "date_trunc('month', {})"


def _dsum(column, mart):
    return f"select sum(cast({column} as decimal(38,2))) from {mart}"


_OWN = "select count(*) from expeditions where kind = 'own'"
_DELIVERED = "select sum(delivered_quantity) from purchase_order_lines"
_OUTSIDE = """select (select count(*) from sales_monthly where historical_cost_coverage_pct not
    between 0 and 100) + (select count(*) from inventory_health_monthly where
    days_cover_coverage_pct not between 0 and 100) + (select count(*) from
    procurement_supplier_monthly where fill_rate_pct not between 0 and 100 or
    within_standard_lead_time_pct not between 0 and 100) + (select count(*) from
    expedition_monthly where same_day_order_expedition_pct not between 0 and 100)"""

_CHECKS = {
    "r01_sales_revenue": (reconcile.sales_revenue, _check_sql(
        "sales revenue", _LINE_REVENUE, _dsum("revenue", "sales_monthly"))),
    "r02_product_sales_revenue": (reconcile.product_sales_revenue, _check_sql(
        "product sales revenue", _dsum("revenue", "sales_monthly"),
        _dsum("revenue", "product_sales_monthly"))),
    "r03_gross_profit_formula": (reconcile.gross_profit_formula, _check_sql(
        "sales gross profit formula", "select 0",
        """select count(*) from sales_monthly where cast(gross_profit as decimal(18,2)) <>
        cast(revenue as decimal(18,2)) - cast(estimated_cost as decimal(18,2))""")),
    "r04_inventory_month_count": (reconcile.inventory_month_count, _check_sql(
        "inventory month count", "select count(*) from inventory_snapshots",
        "select count(*) from inventory_health_monthly")),
    "r05_delivered_units": (reconcile.procurement_delivered_units, _check_sql(
        "procurement delivered units", _DELIVERED,
        "select sum(delivered_units) from procurement_supplier_monthly")),
    "r06_expedition_count": (reconcile.expedition_count, _check_sql(
        "expedition count", "select count(*) from expeditions",
        "select sum(expedition_count) from expedition_monthly")),
    "r07_vehicle_trip_count": (reconcile.vehicle_trip_count, _check_sql(
        "vehicle trip count", _OWN, "select sum(trip_count) from vehicle_utilization_monthly")),
    "r08_management_revenue": (reconcile.management_revenue, _check_sql(
        "management revenue reconciliation", "select 0",
        """select count(*) from management_kpis_monthly m join sales_monthly s
        using (month_start) where m.revenue <> s.revenue""")),
    "r10_sales_months": (reconcile.sales_months, _check_sql(
        "sales_months", f"select count(distinct {_MONTH.format('order_date')}) from sales_orders",
        "select count(*) from sales_monthly", "'MART-E010'", True)),
    "r11_product_sales_months": (reconcile.product_sales_months, _check_sql(
        "product_sales_months", f"""select count(*) from (select distinct
        {_MONTH.format('order_date')}, product_id from sales_orders join sales_order_lines
        using (order_id))""", "select count(*) from product_sales_monthly", "'MART-E010'", True)),
    "r12_inventory_months": (reconcile.inventory_months, _check_sql(
        "inventory_months", "select count(*) from inventory_snapshots",
        "select count(*) from inventory_health_monthly", "'MART-E010'", True)),
    "r13_procurement_supplier_months": (reconcile.procurement_supplier_months, _check_sql(
        "procurement_supplier_months", f"""select count(*) from (select distinct
        {_MONTH.format('order_date')}, supplier_id from purchase_orders)""",
        "select count(*) from procurement_supplier_monthly", "'MART-E010'", True)),
    "r14_expedition_months": (reconcile.expedition_months, _check_sql(
        "expedition_months",
        f"select count(distinct {_MONTH.format('expedition_date')}) from expeditions",
        "select count(*) from expedition_monthly", "'MART-E010'", True)),
    "r15_vehicle_months": (reconcile.vehicle_months, _check_sql(
        "vehicle_months", f"""select count(distinct {_MONTH.format('expedition_date')})
        * (select count(*) from vehicles) from expeditions""",
        "select count(*) from vehicle_utilization_monthly", "'MART-E010'", True)),
    "r16a_published_sales_revenue": (reconcile.published_sales_revenue, _check_sql(
        "sales revenue", _LINE_REVENUE, _dsum("revenue", "sales_monthly"), "'MART-E020'", True)),
    "r16b_published_product_revenue": (reconcile.published_product_revenue, _check_sql(
        "product revenue", _LINE_REVENUE, _dsum("revenue", "product_sales_monthly"),
        "'MART-E021'", True)),
    "r17_published_gross_profit": (reconcile.published_gross_profit, _check_sql(
        "gross profit", f"select ({_LINE_REVENUE}) - ({_dsum('estimated_cost', 'sales_monthly')})",
        _dsum("gross_profit", "sales_monthly"), "'MART-E022'", extra="e is null or a is null")),
    "r18_published_delivered_units": (reconcile.published_delivered_units, _check_sql(
        "procurement delivered units", _DELIVERED,
        "select sum(delivered_units) from procurement_supplier_monthly", "'MART-E030'", True)),
    "r19_published_expeditions": (reconcile.published_expeditions, _check_sql(
        "expedition count", "select count(*) from expeditions",
        "select sum(expedition_count) from expedition_monthly", "'MART-E040'", True)),
    "r20_published_trips": (reconcile.published_trips, _check_sql(
        "fleet trips", _OWN, "select sum(trip_count) from vehicle_utilization_monthly",
        "'MART-E041'", True)),
    "r21_percentages_in_range": (reconcile.percentages_in_range, _check_sql(
        "percentages", "select 0", _OUTSIDE, "'MART-E050'")),
}

QUERIES = {name: _over_marts(plan) for name, (plan, _) in _CHECKS.items()}
ORACLE = {name: sql for name, (_, sql) in _CHECKS.items()}


def _with_runs(plan):
    def run(spark, directory):
        configure(spark)
        return portable(plan(_runs(spark, directory)))
    return run


QUERIES["r09_latest_run"] = _with_runs(reconcile.latest_run_status)
ORACLE["r09_latest_run"] = f"""
    select case when status <> 'completed' then 'MART-E002' end as code,
           'latest refresh' as check_name, status, status = 'completed' as valid
    from {_RUNS_SQL} order by started_at desc limit 1"""
QUERIES["s16_latest_run"] = _with_runs(refresh.latest_run)
ORACLE["s16_latest_run"] = f"""
    select run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') as started_at, status
    from {_RUNS_SQL} order by started_at desc limit 1"""
QUERIES["r22_management_summary"] = _over_marts(lambda c, m: reconcile.management_summary(m))
ORACLE["r22_management_summary"] = over_core("""
    select count(*) as months, cast(min(month_start) as varchar) as month_min,
           cast(max(month_start) as varchar) as month_max,
           cast(sum(cast(revenue as decimal(38,2))) as double) as revenue,
           cast(sum(cast(gross_profit as decimal(38,2))) as double) as gross_profit
    from management_kpis_monthly""")

# --- read queries -----------------------------------------------------------------------------

_FROM, _TO = date(1996, 3, 15), date(1998, 9, 30)
_RANGE = "month_start between date '1996-03-01' and date '1998-09-01'"


def _range_row(core, marts):
    low, high = serve.resolve_range(marts, "product_sales_monthly", _FROM, None)
    return marts.product_sales_monthly.where(F.col("month_start").between(low, high)).agg(
        F.lit(low).alias("date_from"), F.lit(high).alias("date_to"),
        F.count("*").alias("row_count"))


def _summary_long(core, marts):
    """Q02 with one row per compared KPI."""
    row = serve.summary(marts)
    parts = [
        row.select(
            "selected_month", F.lit(k).alias("kpi"),
            *[F.col(f"{name}.{k}").cast("double").alias(name)
              for name in ("current", "previous_month", "previous_year")],
            F.col(f"month_over_month_pct.{k}").alias("month_over_month_pct"),
            F.col(f"year_over_year_pct.{k}").alias("year_over_year_pct"))
        for k in serve.COMPARED_KPIS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_CHANGE = ("case when n.{k} is null or p.{k} is null or p.{k} = 0 then null else "
           "round_even(100.0::double * (n.{k} - p.{k}) / p.{k}, 2) end")
_SUMMARY = over_core("select * from (" + " union all ".join(f"""
    select cast(n.month_start as varchar) as selected_month, '{k}' as kpi,
           cast(n.{k} as double) as current, cast(p.{k} as double) as previous_month,
           cast(y.{k} as double) as previous_year,
           {_CHANGE.format(k=k)} as month_over_month_pct,
           {_CHANGE.format(k=k).replace('p.', 'y.')} as year_over_year_pct
    from (select * from management_kpis_monthly where month_start = (select max(month_start)
          from management_kpis_monthly where revenue is not null)) n
    left join management_kpis_monthly p on p.month_start = n.month_start - interval 1 month
    left join management_kpis_monthly y on y.month_start = n.month_start - interval 1 year"""
    for k in serve.COMPARED_KPIS) + ")")


def _ranking_sql(where: str, order: str, limit: int) -> str:
    def exact(c, s):
        return f"sum(cast({c} as decimal(18,{s})))"
    return over_core(f"""
        select * from (select product_id, product_name, category, supplier_name,
               cast(sum(units_sold) as bigint) as units_sold,
               cast(sum(order_count) as bigint) as order_count,
               cast(sum(customer_count) as bigint) as customer_count,
               cast({exact('revenue', 2)} as double) as revenue,
               cast({exact('estimated_cost', 2)} as double) as estimated_cost,
               cast({exact('gross_profit', 2)} as double) as gross_profit,
               cast(round(cast(100.0::double * {exact('gross_profit', 2)} / nullif(
                 {exact('revenue', 2)}, 0) as decimal(38,9)), 4) as double)
                 as gross_margin_pct,
               cast(round(cast({exact('revenue', 2)}::double / nullif(sum(units_sold), 0)
                 as decimal(38,9)), 4) as double) as average_unit_price
        from product_sales_monthly where {where} group by all)
        order by {order}, product_id limit {limit}""")


_SUPPLIERS = over_core("""
    select * from (select supplier_id, supplier_name,
           cast(sum(purchase_order_count) as bigint) as purchase_order_count,
           cast(sum(purchase_line_count) as bigint) as purchase_line_count,
           cast(sum(ordered_units) as bigint) as ordered_units,
           cast(sum(delivered_units) as bigint) as delivered_units,
           cast(sum(undelivered_units) as bigint) as undelivered_units,
           cast(sum(cast(ordered_value as decimal(18,2))) as double) as ordered_value,
           cast(sum(cast(delivered_value as decimal(18,2))) as double) as delivered_value,
           cast(round(cast(100.0::double * sum(delivered_units) / nullif(sum(ordered_units), 0)
             as decimal(38,9)), 4) as double) as fill_rate_pct,
           cast(round(cast(sum(cast(average_actual_lead_time_days as decimal(18,2))
             * purchase_line_count)::double / sum(purchase_line_count) as decimal(38,9)), 2)
             as double) as average_actual_lead_time_days,
           cast(round(cast(sum(cast(average_standard_lead_time_days as decimal(18,2))
             * purchase_line_count)::double / sum(purchase_line_count) as decimal(38,9)), 2)
             as double) as average_standard_lead_time_days,
           cast(round(cast(100.0::double * sum(purchase_line_count - late_line_count)
             / sum(purchase_line_count) as decimal(38,9)), 4) as double)
             as within_standard_lead_time_pct,
           cast(sum(late_line_count) as bigint) as late_line_count
    from procurement_supplier_monthly group by 1, 2)
    order by delivered_value desc, supplier_name limit 20""")

_VEHICLES = over_core("""
    select cast(vehicle_id as bigint) as vehicle_id, driver,
           cast(max(capacity_kg) as bigint) as capacity_kg, max(capacity_m3) as capacity_m3,
           cast(sum(trip_count) as bigint) as trip_count,
           cast(sum(active_day_count) as bigint) as active_day_count,
           cast(sum(cast(transported_weight_kg as decimal(18,2))) as double)
             as transported_weight_kg,
           cast(sum(cast(transported_volume_m3 as decimal(18,3))) as double)
             as transported_volume_m3,
           cast(round(cast(sum(cast(average_weight_utilization_pct as decimal(18,4))
             * trip_count)::double / nullif(sum(trip_count), 0) as decimal(38,9)), 4) as double)
             as average_weight_utilization_pct,
           cast(round(cast(sum(cast(average_volume_utilization_pct as decimal(18,4))
             * trip_count)::double / nullif(sum(trip_count), 0) as decimal(38,9)), 4) as double)
             as average_volume_utilization_pct,
           max(maximum_weight_utilization_pct) as maximum_weight_utilization_pct,
           max(maximum_volume_utilization_pct) as maximum_volume_utilization_pct,
           cast(sum(overloaded_trips) as bigint) as overloaded_trips
    from vehicle_utilization_monthly group by 1, 2""")


def _status(spark, directory):
    core = core_from_tables(configure(spark), directory)
    return portable(serve.status(stored_marts(core), _runs(spark, directory)))


_SERIES = {"revenue": "Tržby", "estimated_cost": "Náklady", "gross_profit": "Hrubý zisk"}
_LABELS = {"month_start": "Mesiac", "revenue": "Tržby", "units_sold": "Kusy"}

_READS = {
    "q00_resolve_range": (_range_row, over_core("""
        select '1996-03-01' as date_from, (select cast(max(month_start) as varchar)
               from product_sales_monthly) as date_to, count(*) as row_count
        from product_sales_monthly where month_start >= date '1996-03-01'""")),
    "q02_summary": (_summary_long, _SUMMARY),
    "q03_monthly": (lambda c, m: serve.monthly(m, _FROM, _TO), over_core(dates_as_text(
        "*", f"management_kpis_monthly where {_RANGE}", "month_start"))),
    "q04_product_ranking": (
        lambda c, m: serve.product_ranking(m, limit=100),
        _ranking_sql("true", "revenue desc nulls first", 100)),
    "q04a_product_ranking_filtered": (
        lambda c, m: serve.product_ranking(m, _FROM, _TO, category="ECONOMY",
                                           supplier="Supplier#000000001",
                                           sort_by="gross_margin_pct", direction="ASC",
                                           limit=10),
        _ranking_sql(_RANGE + " and category = 'ECONOMY' and supplier_name = "
                     "'Supplier#000000001'", "gross_margin_pct asc nulls last", 10)),
    "q05_filter_options": (
        lambda c, m: serve.filter_options(m).select(
            F.array_join("categories", "|").alias("categories"),
            F.array_join("suppliers", "|").alias("suppliers")),
        over_core("""select string_agg(distinct category, '|' order by category) as categories,
        string_agg(distinct supplier_name, '|' order by supplier_name) as suppliers
        from product_sales_monthly""")),
    "q05a_filter_values": (
        lambda c, m: serve.filter_values(m),
        over_core("""select 'category' as kind, category as value from product_sales_monthly where category is not null
        union select 'supplier', supplier_name from product_sales_monthly where supplier_name is not null""")),
    "q06_inventory": (lambda c, m: serve.inventory(m, _FROM, _TO), over_core(dates_as_text(
        "*", f"inventory_health_monthly where {_RANGE}", "month_start"))),
    "q07_supplier_ranking": (lambda c, m: serve.supplier_ranking(m), _SUPPLIERS),
    "q08_expeditions": (lambda c, m: serve.expeditions(m, _FROM, _TO), over_core(dates_as_text(
        "*", f"expedition_monthly where {_RANGE}", "month_start"))),
    "q09_vehicles": (lambda c, m: serve.vehicles(m), _VEHICLES),
    "v01_series": (
        lambda c, m: views.series(m.management_kpis_monthly, _SERIES),
        over_core("select cast(month_start as varchar) as month, series, value from ("
                  + " union all ".join(f"select month_start, '{label}' as series, "
                                       f"{column} as value from management_kpis_monthly"
                                       for column, label in _SERIES.items())
                  + ") where value is not null")),
    "v02_ranked_bars": (
        lambda c, m: views.ranked_bars(serve.supplier_ranking(m), "supplier_name",
                                       "delivered_value"),
        "select supplier_name as category, delivered_value as value from ("
        + _SUPPLIERS + ") where delivered_value is not null"),
    "v03_report_table": (
        lambda c, m: views.report_table(m.management_kpis_monthly, _LABELS, "month_start"),
        over_core("""select strftime(month_start, '%m/%Y') as "Mesiac", revenue as "Tržby",
        units_sold as "Kusy" from management_kpis_monthly""")),
    "v04_sales_month_choices": (
        lambda c, m: views.sales_month_choices(m, date(1997, 1, 1)),
        over_core("""select cast(month_start as varchar) as month_start from
        management_kpis_monthly where revenue is not null and
        month_start >= date '1997-01-01'""")),
    "v05_latest_inventory": (
        lambda c, m: views.latest_inventory(serve.inventory(m, _FROM, _TO)),
        over_core(dates_as_text("*", f"""inventory_health_monthly where {_RANGE}
        order by inventory_health_monthly.month_start desc limit 1""", "month_start"))),
    "s14_mart_row_counts": (lambda c, m: serve.mart_row_counts(m), over_core(" union all ".join(
        f"select '{name}' as mart, count(*) as row_count from {name}" for name in MART_TABLES))),
    "v06_dataset_sizes": (lambda c, m: views.dataset_sizes(m), over_core(" union all ".join(
        f"select '{label}' as dataset, count(*) as row_count from {name}"
        for name, label in views.DATASET_LABELS.items()))),
    "s12_source_summary": (lambda c, m: refresh.source_summary(c), over_core("select "
        + ", ".join(f"(select count(*) from {n}) as {n}" for n in (
            "sales_orders", "sales_order_lines", "purchase_orders", "purchase_order_lines",
            "inventory_snapshots", "inventory_snapshot_lines", "expeditions", "vehicles"))
        + """, (select cast(min(order_date) as varchar) from sales_orders) as sales_min,
        (select cast(max(order_date) as varchar) from sales_orders) as sales_max,
        (select cast(max(expedition_date) as varchar) from expeditions) as expedition_max""")),
}
QUERIES.update({name: _over_marts(plan) for name, (plan, _) in _READS.items()})
ORACLE.update({name: sql for name, (_, sql) in _READS.items()})
QUERIES["q01_status"] = _status
ORACLE["q01_status"] = over_core(f"""
    select case when r.status = 'completed' then 'ready' else 'not_ready' end as status,
           r.status as latest_refresh_status,
           (select cast(min(month_start) as varchar) from management_kpis_monthly) as month_min,
           (select cast(max(month_start) as varchar) from management_kpis_monthly) as month_max,
           (select cast(min(month_start) filter (where revenue is not null) as varchar)
            from management_kpis_monthly) as sales_month_min,
           (select cast(max(month_start) filter (where revenue is not null) as varchar)
            from management_kpis_monthly) as sales_month_max,
           {', '.join(f'(select count(*) from {n}) as {n}_rows' for n in MART_TABLES)}
    from (select status from {_RUNS_SQL} order by started_at desc limit 1) r""")


def _refresh_checks(core, marts):
    return reconcile.refresh_checks(core, marts).select("check_name", "valid")


QUERIES["s15_refresh_checks"] = _over_marts(_refresh_checks)
ORACLE["s15_refresh_checks"] = " union all ".join(
    f"select check_name, valid from ({ORACLE[n]})" for n in ORACLE
    if n[:3] in ("r01", "r02", "r03", "r04", "r05", "r06", "r07", "r08"))
