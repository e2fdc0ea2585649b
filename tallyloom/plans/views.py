"""The tables the registered queries read, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.context import SchemaMap


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- sales: one row per order line -------------------------------------------------------

# slot -> (table that holds it, expression over that table)
_SALES = {
    "order_id": ("lineitem", "l_orderkey"),
    "line_no": ("lineitem", "l_linenumber"),
    "product_id": ("lineitem", "l_partkey"),
    "quantity": ("lineitem", "l_quantity"),
    "unit_price": ("lineitem", "l_extendedprice / l_quantity"),
    "revenue": ("lineitem", "l_extendedprice * (1 - l_discount)"),
    "date": ("orders", "cast(o_orderdate as date)"),
    "customer_id": ("orders", "o_custkey"),
    "customer_name": ("customer", "c_name"),
    "department": ("customer", "c_mktsegment"),
    "state": ("nation", "n_name"),
    "region": ("region", "r_name"),
    "product_name": ("part", "p_name"),
    "brand": ("part", "p_brand"),
    "category": ("part", "p_type"),
    "inventory": ("part", "p_size"),
    "cost": ("part", "0.6 * l_quantity * p_retailprice"),
}

SALES_SCHEMA: SchemaMap = {
    k: k for k in ("order_id", "date", "customer_id", "customer_name", "product_id", "product_name",
                   "category", "department", "region", "state", "quantity", "unit_price", "revenue",
                   "cost", "inventory")
}

SALES_SQL = "sales as (select " + ", ".join(f"{e} as {s}" for s, (_, e) in _SALES.items()) + """
  from lineitem
  left join orders on l_orderkey = o_orderkey
  left join customer on o_custkey = c_custkey
  left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey
  left join part on l_partkey = p_partkey)"""


def sales(spark: SparkSession, sf_dir: str, *slots: str) -> DataFrame:
    """The sales view, joining only the tables the asked-for slots live in.

    Every join is a left join to a unique key, so leaving a table out changes no row.
    Customer attributes are attached to orders first: that moves the smaller side once
    instead of moving every order line again.
    """
    slots = slots or tuple(_SALES)
    tables = {_SALES[s][0] for s in slots}
    lines = load(spark, sf_dir, "lineitem")
    if tables & {"orders", "customer", "nation", "region"}:
        orders = load(spark, sf_dir, "orders")
        if tables & {"customer", "nation", "region"}:
            customers = load(spark, sf_dir, "customer")
            if tables & {"nation", "region"}:
                places = load(spark, sf_dir, "nation")
                if "region" in tables:
                    regions = load(spark, sf_dir, "region")
                    places = places.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
                customers = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "part" in tables:
        lines = lines.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines.select(*[F.expr(_SALES[s][1]).alias(s) for s in slots])


# --- messy orders: text columns written the ways real files write them ---------------------

_WHOLE = "cast(cast(floor(o_totalprice) as bigint) as string)"
_FRAC = "lpad(cast(cast(round(o_totalprice * 100) as bigint) % 100 as string), 2, '0')"
_THOUSANDS = "cast(cast(floor(o_totalprice / 1000) as bigint) as string)"
_REST = "lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as string), 3, '0')"
_DAY = "lpad(cast(day(o_orderdate) as string), 2, '0')"
_MONTH = "lpad(cast(month(o_orderdate) as string), 2, '0')"
_YEAR = "cast(year(o_orderdate) as string)"
_GROUPED = f"{_THOUSANDS} || ',' || {_REST} || '.' || {_FRAC}"
_EURO = f"{_THOUSANDS} || '.' || {_REST} || ',' || {_FRAC}"

# One text works in both engines.
MESSY_COLUMNS = {
    "order_key": "o_orderkey",
    "amount_text": f"""case o_orderkey % 10
        when 0 then '$' || {_GROUPED}
        when 1 then '(' || {_WHOLE} || '.' || {_FRAC} || ')'
        when 2 then {_WHOLE} || '.' || {_FRAC} || '-'
        when 3 then ' ' || {_WHOLE} || ' '
        when 4 then '$(' || {_GROUPED} || ')'
        when 5 then {_WHOLE} || ' kg'
        when 6 then ''
        when 7 then case when o_orderkey % 20 = 7 then null else 'n/a' end
        when 8 then {_GROUPED}
        else '-' || {_WHOLE} || '.' || {_FRAC} end""",
    "euro_text": f"""case o_orderkey % 5
        when 0 then {_EURO}
        when 1 then {_WHOLE} || ',' || {_FRAC}
        when 2 then {_WHOLE}
        when 3 then '€ ' || {_EURO}
        else '(' || {_WHOLE} || ',' || {_FRAC} || ')' end""",
    "space_text": f"{_THOUSANDS} || ' ' || {_REST}",
    "dmy_text": f"""case when o_orderkey % 13 = 0 then '31/04/' || {_YEAR}
        when o_orderkey % 11 = 0 then {_DAY} || '-' || {_MONTH} || '-' || substr({_YEAR}, 3, 2)
        else {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} end""",
    "mdy_text": f"{_MONTH} || '/' || {_DAY} || '/' || {_YEAR}",
    "iso_text": f"""case when o_orderkey % 19 = 0 then '   '
        when o_orderkey % 17 = 0 then '  ' || {_YEAR} || '-' || {_MONTH} || '-' || {_DAY}
        else {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} end""",
    "instant_text": f"""{_YEAR} || '-' || {_MONTH} || '-' || {_DAY} || 'T' ||
        lpad(cast(o_orderkey % 24 as string), 2, '0') || ':30:00' ||
        case o_orderkey % 3 when 0 then 'Z' when 1 then '+05:30' else '-08:00' end""",
    "vague_text": f"lpad(cast(1 + day(o_orderdate) % 12 as string), 2, '0') || '/' || {_MONTH} || '/' || {_YEAR}",
    "segment_text": """case o_orderkey % 4 when 0 then o_orderpriority when 1 then lower(o_orderpriority)
        when 2 then '  ' || o_orderpriority || ' ' else upper(o_orderpriority) end""",
    "flag_text": """case when o_orderkey % 9 = 0 then null when o_orderkey % 2 = 0 then 'Yes' else 'no' end""",
    "empty_text": "case when o_orderkey % 2 = 0 then '' else cast(null as string) end",
    "person_text": """case o_orderkey % 3 when 0 then 'mcdonald ' || lower(o_orderstatus) when 1
        then 'JOHN  SMITH' else 'o''neil-' || o_orderstatus || ' mcLEOD' end""",
    "formula_text": """case o_orderkey % 6 when 0 then '=SUM(A1)' when 1 then '+' || o_orderstatus when 2 then '-2'
        when 3 then '@x' else o_orderstatus end""",
    "odd-name": "o_orderstatus",
}
MESSY_TEXT = [c for c in MESSY_COLUMNS if c != "order_key"]

_MESSY_SELECT = ",\n".join(f'{e} as "{c}"' for c, e in MESSY_COLUMNS.items())
MESSY_SQL = f"""messy as (select {_MESSY_SELECT} from orders
  union all select {_MESSY_SELECT} from orders where o_orderkey % 37 = 0)"""


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as badly written text; every 37th row is there twice."""
    orders = load(spark, sf_dir, "orders")
    twice = F.when(F.col("o_orderkey") % 37 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    repeated = orders.withColumn("_copy", F.explode(twice))
    return repeated.select(*[F.expr(e).alias(c) for c, e in MESSY_COLUMNS.items()])


# --- sheets: whole text tables as an uploaded file would hold them ---------------------------

ORDER_SHEET = {
    "order_id": "cast(o_orderkey as string)",
    "order_date": f"{_YEAR} || '-' || {_MONTH} || '-' || {_DAY}",
    "customer_code": "lpad(cast(o_custkey as string), 6, '0')",
    "status": "o_orderstatus",
    "priority": "o_orderpriority",
    "total_sales": f"{_WHOLE} || '.' || {_FRAC}",
    "total_cost": f"cast(cast(floor(o_totalprice * 0.6) as bigint) + 20000 as string) || '.5'",
    "discount_rate": "'0.' || lpad(cast(o_orderkey % 97 as string), 2, '0')",
    "balance": "case when o_orderkey % 20 = 0 then '-' else '' end || cast(cast(floor(o_totalprice / 7) as bigint) as string)",
    "order_year": _YEAR,
    "rating": "cast(o_orderkey % 5 + 1 as string)",
    "is_rush": "case when o_orderkey % 2 = 0 then 'yes' else 'no' end",
    "constant_text": "'x'",
    "mostly_blank": "case when o_orderkey % 50 = 0 then 'y' else '' end",
    "remark": "'note ' || cast(o_orderkey as string) || case when o_orderkey % 2 = 0 then ' late' else '' end",
}
SHIPMENT_SHEET = {
    "Invoice No": "cast(l_orderkey as string)",
    "SKU": "'P-' || cast(l_partkey as string)",
    "Qty": "cast(cast(l_quantity as bigint) as string)",
    "Unit Price": "cast(cast(floor(l_extendedprice / l_quantity) as bigint) as string)",
    "Amount": "'$' || cast(cast(floor(l_extendedprice) as bigint) as string)",
    "Ship Date": "cast(cast(l_shipdate as date) as string)",
    "Plan": "l_returnflag",
    "Subscription": "l_linestatus",
}
EVENT_SHEET = {
    "event_id": "cast(event_id as string)",
    "timestamp": "cast(cast(ts as date) as string)",
    "machine": "event_type",
    "defect": "cast(cast(floor(value) as bigint) as string)",
    "patient": "'u' || cast(user_id as string)",
    "prescription": "'rx' || cast(event_id % 40 as string)",
    "period": "'p' || cast(user_id % 3 as string)",
}
SHEETS = {"orders": ORDER_SHEET, "shipments": SHIPMENT_SHEET, "events": EVENT_SHEET}
_SHEET_TABLE = {"orders": "orders", "shipments": "lineitem", "events": "events"}


def sheet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = load(spark, sf_dir, _SHEET_TABLE[name])
    return table.select(*[F.expr(e).alias(c) for c, e in SHEETS[name].items()])


def sheet_sql(name: str) -> str:
    columns = ", ".join(f'{e} as "{c}"' for c, e in SHEETS[name].items())
    return f"{name}_sheet as (select {columns} from {_SHEET_TABLE[name]})"


def sheet_cells_sql(*names: str) -> str:
    """`cells(col, v)` over one sheet, or over several with the sheet's name in front of the column."""
    def label(name, column):
        return column if len(names) == 1 else f"{name}/{column}"

    return ", ".join(sheet_sql(n) for n in names) + ", cells as (" + " union all ".join(
        f"select '{label(n, c)}' as col, \"{c}\" as v from {n}_sheet" for n in names for c in SHEETS[n]) + ")"


def ident(name: str) -> str:
    """A column name that may hold spaces or dashes, quoted for Spark."""
    return "`" + name.replace("`", "``") + "`"


CELLS_SQL = MESSY_SQL + ", cells as (" + " union all ".join(
    f"select '{c}' as col, \"{c}\" as v from messy" for c in MESSY_TEXT) + ")"
