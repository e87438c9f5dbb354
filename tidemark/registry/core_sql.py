"""Oracle SQL: the core tables over the driver's views, money in whole cents.

Written apart from the Spark plans: integers throughout, correlated lookups and plain
aggregates instead of reduced timelines.
"""

from __future__ import annotations


def half_up(expression: str, places: int) -> str:
    """Round a double half away from zero at ``places``, as a double."""
    return (f"cast(round(cast(({expression}) as decimal(38,9)), {places}) as double)")


# name -> CTE body; each may use the ones before it
CORE_CTES: dict[str, str] = {
    "suppliers": "select s_suppkey as id, s_name as supplier_name from supplier",
    "customers": "select c_custkey as customer_id, c_name as customer_name from customer",
    "products": """
        select p_partkey as product_id, p_name as product_name, p_type as category,
               cast(floor(p_retailprice * 100) as bigint) as purchase_price,
               cast(floor(p_retailprice * 125) as bigint) as sales_price,
               p_partkey % (select count(*) from supplier) as supplier_id,
               p_partkey % 5 + 1 as minimum_order_quantity, p_size as lead_time_days,
               p_size * 10 as weight_g, p_size * 3 as volume_u
        from part""",
    "vehicles": """
        select n_nationkey as vehicle_id, (n_nationkey % 6 + 1) * 800 as capacity_kg,
               (n_nationkey % 6 + 1) * 500 as capacity_100, n_name as driver from nation""",
    "sales_orders": """
        select o_orderkey as order_id, cast(o_orderdate as date) as order_date,
               o_custkey as customer_id, o_custkey % 8 as region_no, o_totalprice,
               o_orderdate + to_minutes(o_orderkey % 600) as received_at,
               o_orderdate + to_minutes(o_orderkey % 600)
                 + to_minutes(60 + (o_orderkey * 7) % 2880) as picked_at
        from orders where o_orderkey in
            (select l_orderkey from lineitem where l_returnflag <> 'R')""",
    "sales_order_lines": """
        select l_orderkey as order_id, l_linenumber as line_number, l_partkey as product_id,
               cast(l_quantity as bigint) as quantity,
               cast(floor(l_extendedprice * 100 / l_quantity) as bigint) as unit_price
        from lineitem where l_returnflag <> 'R'""",
    "purchase_orders": """
        select o_orderkey as purchase_order_id, cast(o_orderdate as date) as order_date,
               o_custkey % (select count(*) from supplier) as supplier_id
        from orders where o_orderkey in
            (select l_orderkey from lineitem where l_returnflag = 'R')""",
    "purchase_order_lines": """
        select l_orderkey as purchase_order_id, l_linenumber as line_number,
               cast(l_shipdate as date) as delivery_date, l_partkey as product_id,
               cast(l_quantity as bigint) as ordered_quantity,
               case when l_linestatus = 'F' then cast(l_quantity as bigint)
                    else cast(floor(l_quantity * 0.9::double) as bigint) end
                 as delivered_quantity,
               cast(floor(l_extendedprice * (1 - l_discount) * 100 / l_quantity) as bigint)
                 as purchase_price
        from lineitem where l_returnflag = 'R'""",
    "inventory_snapshots": """
        select distinct cast(date_trunc('month', order_date) as date) as snapshot_date
        from sales_orders""",
    "inventory_snapshot_lines": """
        select snapshot_date, p_partkey as product_id,
               (p_partkey * 7 + year(snapshot_date) * 12 + month(snapshot_date) * 13) % 101
                 as stock_available,
               p_partkey % 7 as stock_reserved,
               p_partkey % 10 + 5 as min_stock, p_partkey % 30 + 60 as max_stock
        from inventory_snapshots cross join part""",
    "expeditions": """
        select order_id, order_date, received_at, picked_at,
               cast(picked_at as date) + cast(trunc(order_id % 4 / 2) as integer)
                 as expedition_date,
               case order_id % 3 when 0 then 'own' when 1 then 'carrier' else 'pickup' end
                 as kind,
               case when order_id % 3 = 0 then (order_id // 3) % 25 end as vehicle_id,
               cast(floor(o_totalprice) as bigint) % 500000 as weight_100,
               cast(floor(o_totalprice) as bigint) % 30000 as volume_1000
        from sales_orders""",
    "price_points": """
        select product_id, order_date, delivery_date, purchase_price,
               row_number() over (partition by product_id order by order_date, delivery_date,
                 purchase_order_id, line_number, purchase_price) as seq
        from purchase_order_lines join purchase_orders using (purchase_order_id)""",
    "days_wanted": """
        select distinct product_id, order_date as day
        from sales_order_lines join sales_orders using (order_id)
        union select product_id, snapshot_date from inventory_snapshot_lines""",
    "historical": """
        select w.product_id, w.day, arg_max(p.purchase_price, p.seq) as price
        from days_wanted w join price_points p
          on p.product_id = w.product_id and p.order_date <= w.day
        group by 1, 2""",
    "priced": """
        select cast(date_trunc('month', o.order_date) as date) as month_start, o.order_id,
               o.customer_id, l.product_id, l.quantity, l.unit_price, o.order_date,
               coalesce(h.price, p.purchase_price) as unit_cost,
               h.price is not null as known
        from sales_order_lines l join sales_orders o using (order_id)
        join products p using (product_id)
        left join historical h on h.product_id = l.product_id and h.day = o.order_date""",
    "sales_monthly": f"""
        select month_start,
               sum(quantity * unit_price) / 100.0::double as revenue,
               sum(quantity * unit_cost) / 100.0::double as estimated_cost,
               sum(quantity * (unit_price - unit_cost)) / 100.0::double as gross_profit,
               {half_up("100.0::double * sum(quantity * (unit_price - unit_cost)) "
                        "/ nullif(sum(quantity * unit_price), 0)", 4)} as gross_margin_pct,
               cast(sum(quantity) as bigint) as units_sold,
               count(distinct order_id) as order_count,
               count(distinct customer_id) as customer_count,
               {half_up("sum(quantity * unit_price) / 100.0::double "
                        "/ count(distinct order_id)", 2)} as average_order_value,
               count(*) as sales_line_count,
               count(*) filter (where known) as historical_cost_line_count,
               count(*) filter (where not known) as fallback_cost_line_count,
               {half_up("100.0::double * count(*) filter (where known) / count(*)", 4)}
                 as historical_cost_coverage_pct
        from priced group by month_start""",
    "product_sales_monthly": f"""
        select month_start, product_id, product_name, category, supplier_name,
               cast(sum(quantity) as bigint) as units_sold,
               count(distinct order_id) as order_count,
               count(distinct customer_id) as customer_count,
               sum(quantity * unit_price) / 100.0::double as revenue,
               sum(quantity * unit_cost) / 100.0::double as estimated_cost,
               sum(quantity * (unit_price - unit_cost)) / 100.0::double as gross_profit,
               {half_up("100.0::double * sum(quantity * (unit_price - unit_cost)) "
                        "/ nullif(sum(quantity * unit_price), 0)", 4)} as gross_margin_pct,
               {half_up("sum(quantity * unit_price) / 100.0::double "
                        "/ nullif(sum(quantity), 0)", 4)} as average_unit_price,
               {half_up("100.0::double * count(*) filter (where known) / count(*)", 4)}
                 as historical_cost_coverage_pct
        from priced join products using (product_id)
        join suppliers on suppliers.id = products.supplier_id
        group by all""",
    "monthly_units": """
        select month_start, product_id, cast(sum(quantity) as bigint) as units_sold
        from priced group by all""",
    "stock_lines": """
        select l.snapshot_date as month_start, l.product_id, l.stock_available, l.min_stock,
               l.max_stock, p.sales_price, coalesce(h.price, p.purchase_price) as unit_cost,
               h.price is not null as known, u.units_sold,
               case when u.units_sold > 0
                    then l.stock_available * 30.4375::double / u.units_sold end as cover
        from inventory_snapshot_lines l join products p using (product_id)
        left join monthly_units u
          on u.month_start = l.snapshot_date and u.product_id = l.product_id
        left join historical h on h.product_id = l.product_id and h.day = l.snapshot_date""",
    "inventory_health_monthly": f"""
        select month_start, count(*) as product_count,
               count(*) filter (where stock_available = 0) as stockout_products,
               count(*) filter (where stock_available < min_stock) as below_min_products,
               count(*) filter (where stock_available > max_stock) as above_max_products,
               count(*) filter (where stock_available between min_stock and max_stock)
                 as healthy_products,
               sum(stock_available * unit_cost) / 100.0::double as inventory_cost_value,
               sum(stock_available * sales_price) / 100.0::double as inventory_sales_value,
               sum(stock_available * (sales_price - unit_cost)) / 100.0::double
                 as inventory_potential_margin_value,
               count(*) filter (where units_sold > 0) as products_with_month_sales,
               count(*) filter (where coalesce(units_sold, 0) = 0)
                 as products_without_month_sales,
               count(*) filter (where known) as historical_cost_product_count,
               count(*) filter (where not known) as fallback_cost_product_count,
               {half_up("100.0::double * count(*) filter (where units_sold > 0) / count(*)",
                        4)} as days_cover_coverage_pct,
               {half_up("avg(cover)", 2)} as average_days_of_cover,
               {half_up("quantile_cont(cover, 0.5)", 2)} as median_days_of_cover
        from stock_lines group by month_start""",
    "procurement_supplier_monthly": f"""
        select cast(date_trunc('month', o.order_date) as date) as month_start, s.id
                 as supplier_id, s.supplier_name,
               count(distinct o.purchase_order_id) as purchase_order_count,
               count(*) as purchase_line_count,
               cast(sum(ordered_quantity) as bigint) as ordered_units,
               cast(sum(delivered_quantity) as bigint) as delivered_units,
               cast(sum(ordered_quantity - delivered_quantity) as bigint)
                 as undelivered_units,
               sum(ordered_quantity * l.purchase_price) / 100.0::double as ordered_value,
               sum(delivered_quantity * l.purchase_price) / 100.0::double
                 as delivered_value,
               {half_up("100.0::double * sum(delivered_quantity) "
                        "/ nullif(sum(ordered_quantity), 0)", 4)} as fill_rate_pct,
               {half_up("avg(delivery_date - o.order_date)", 2)}
                 as average_actual_lead_time_days,
               {half_up("avg(lead_time_days)", 2)} as average_standard_lead_time_days,
               {half_up("100.0::double * count(*) filter "
                        "(where delivery_date - o.order_date <= lead_time_days) / count(*)",
                        4)} as within_standard_lead_time_pct,
               count(*) filter (where delivery_date - o.order_date > lead_time_days)
                 as late_line_count
        from purchase_orders o join purchase_order_lines l using (purchase_order_id)
        join suppliers s on s.id = o.supplier_id join products p using (product_id)
        group by 1, 2, 3""",
    "expedition_monthly": f"""
        select cast(date_trunc('month', expedition_date) as date) as month_start,
               count(*) as expedition_count,
               count(*) filter (where kind = 'own') as own_delivery_expeditions,
               count(*) filter (where kind = 'carrier') as external_delivery_expeditions,
               count(*) filter (where kind = 'pickup') as pickup_expeditions,
               sum(weight_100) / 100.0::double as total_weight_kg,
               sum(volume_1000) / 1000.0::double as total_volume_m3,
               {half_up("avg(date_diff('minute', received_at, picked_at)) / 60", 2)}
                 as average_picking_hours,
               {half_up("quantile_cont(date_diff('minute', received_at, picked_at)::double, "
                        "0.5) / 60", 2)} as median_picking_hours,
               {half_up("avg(expedition_date - order_date)", 2)}
                 as average_order_to_expedition_days,
               {half_up("100.0::double * count(*) filter (where expedition_date = order_date)"
                        " / count(*)", 4)} as same_day_order_expedition_pct
        from expeditions group by 1""",
    "vehicle_utilization_monthly": f"""
        select m.month_start, v.vehicle_id, v.driver, v.capacity_kg,
               v.capacity_100 / 100.0::double as capacity_m3,
               count(e.order_id) as trip_count,
               count(distinct e.expedition_date) as active_day_count,
               coalesce(sum(weight_100), 0) / 100.0::double as transported_weight_kg,
               coalesce(sum(volume_1000), 0) / 1000.0::double as transported_volume_m3,
               {half_up("sum(weight_100)::double / count(e.order_id) "
                        "/ nullif(v.capacity_kg, 0)", 4)} as average_weight_utilization_pct,
               {half_up("10.0::double * sum(volume_1000) / count(e.order_id) "
                        "/ nullif(v.capacity_100, 0)", 4)} as average_volume_utilization_pct,
               {half_up("max(weight_100)::double / nullif(v.capacity_kg, 0)", 4)}
                 as maximum_weight_utilization_pct,
               {half_up("10.0::double * max(volume_1000) / nullif(v.capacity_100, 0)", 4)}
                 as maximum_volume_utilization_pct,
               count(e.order_id) filter (where weight_100 > v.capacity_kg * 100
                 or volume_1000 > v.capacity_100 * 10) as overloaded_trips
        from (select distinct cast(date_trunc('month', expedition_date) as date)
              as month_start from expeditions) m
        cross join vehicles v
        left join expeditions e
          on cast(date_trunc('month', e.expedition_date) as date) = m.month_start
         and e.vehicle_id = v.vehicle_id and e.kind = 'own'
        group by m.month_start, v.vehicle_id, v.driver, v.capacity_kg, v.capacity_100""",
    "all_months": """
        select month_start from sales_monthly
        union select month_start from inventory_health_monthly
        union select month_start from procurement_supplier_monthly
        union select month_start from expedition_monthly""",
    "spine": """
        select cast(unnest(generate_series(min(month_start), max(month_start),
               interval 1 month)) as date) as month_start from all_months""",
    "procurement_by_month": f"""
        select month_start,
               round(sum(delivered_value), 2) as procurement_delivered_value,
               {half_up("100.0::double * sum(delivered_units) "
                        "/ nullif(sum(ordered_units), 0)", 4)} as procurement_fill_rate_pct,
               {half_up("sum(cast(average_actual_lead_time_days as decimal(18,2)) "
                        "* purchase_line_count)::double / sum(purchase_line_count)", 2)}
                 as average_procurement_lead_time_days,
               {half_up("100.0::double * sum(purchase_line_count - late_line_count) "
                        "/ sum(purchase_line_count)", 4)} as procurement_within_standard_pct
        from procurement_supplier_monthly group by month_start""",
    "fleet_by_month": f"""
        select month_start, cast(sum(trip_count) as bigint) as own_fleet_trip_count,
               {half_up("sum(cast(average_weight_utilization_pct as decimal(18,4)) "
                        "* trip_count)::double / nullif(sum(trip_count), 0)", 4)}
                 as average_vehicle_weight_utilization_pct,
               {half_up("sum(cast(average_volume_utilization_pct as decimal(18,4)) "
                        "* trip_count)::double / nullif(sum(trip_count), 0)", 4)}
                 as average_vehicle_volume_utilization_pct
        from vehicle_utilization_monthly group by month_start""",
    "management_kpis_monthly": """
        select s.month_start, m.revenue, m.estimated_cost, m.gross_profit, m.gross_margin_pct,
               m.units_sold, m.order_count as sales_order_count, m.customer_count,
               i.inventory_cost_value, i.stockout_products, i.below_min_products,
               i.above_max_products, i.average_days_of_cover,
               p.procurement_delivered_value, p.procurement_fill_rate_pct,
               p.average_procurement_lead_time_days, p.procurement_within_standard_pct,
               e.expedition_count, e.own_delivery_expeditions,
               e.external_delivery_expeditions, e.pickup_expeditions,
               e.average_picking_hours, f.own_fleet_trip_count,
               f.average_vehicle_weight_utilization_pct,
               f.average_vehicle_volume_utilization_pct
        from spine s left join sales_monthly m using (month_start)
        left join inventory_health_monthly i using (month_start)
        left join procurement_by_month p using (month_start)
        left join expedition_monthly e using (month_start)
        left join fleet_by_month f using (month_start)""",
}


def over_core(query: str) -> str:
    """``query`` over the core and mart CTEs it mentions (directly or through another CTE)."""
    wanted: list[str] = []
    text = query
    for name in reversed(list(CORE_CTES)):
        if _mentions(text, name):
            wanted.append(name)
            text += "\n" + CORE_CTES[name]
    parts = [f"{name} as materialized ({CORE_CTES[name]})" for name in CORE_CTES
             if name in wanted]
    return f"with {', '.join(parts)}\n{query}" if parts else query


def _mentions(text: str, name: str) -> bool:
    padded = "".join(c if c.isalnum() or c == "_" else " " for c in text).split()
    return name in padded


def dates_as_text(columns: str, source: str, *dates: str) -> str:
    """``select`` with the named date columns as ISO text."""
    replaced = ", ".join(f"cast({d} as varchar) as {d}" for d in dates)
    return f"select {columns} replace ({replaced}) from {source}"
