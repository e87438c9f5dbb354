"""Registered queries: landing, typing, contract checks, profiles, core loads, batch records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.model import CORE_KEYS, CORE_REFERENCES, SHEET_KEYS, SHEETS
from tidemark.operators.upsert import upsert
from tidemark.plans import audit, contract, core_load, importing, profiles, rules, staging
from tidemark.plans.contract import ContractColumn
from tidemark.registry.core_sql import over_core
from tidemark.registry.portable import portable
from tidemark.registry.rules import ORACLE as RULE_ORACLE
from tidemark.registry.rules import _loaded_core as gate_core
from tidemark.registry.rules import _SQL as RULE_SQL
from tidemark.registry.sheet_sql import SHEET_SQL, flawed_sheets, over_sheets, raw_rows
from tidemark.session import configure, shared_dir
from tidemark.sources import landing
from tidemark.sources.tables import core_from_tables, table

QUERIES: dict = {}
ORACLE: dict = {}


def _over_sheets(name: str, plan, sql: str | None = None) -> None:
    def run(spark, directory):
        return portable(plan(flawed_sheets(configure(spark), directory)))
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = over_sheets(sql)


def _over_tables(name: str, plan, sql: str | None = None) -> None:
    def run(spark, directory):
        configure(spark)
        return portable(plan(lambda t: table(spark, directory, t)))
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def _columns(sheet: str) -> list[str]:
    return [c for c, _, _ in SHEETS[sheet]]


# --- S01, S03 - S08 -------------------------------------------------------------------------------

_JSON_TEXT = {"date": "cast({} as varchar)", "datetime": "strftime({}, '%Y-%m-%dT%H:%M:%S')",
              "text": "{}", "integer": "{}"}


def _json_object(sheet: str) -> str:
    cells = [f"'{c}', " + _JSON_TEXT.get(t, "cast({} as varchar)").format(c)
             for c, t, _ in SHEETS[sheet]]
    return f"cast(json_object({', '.join(cells)}) as varchar)"


for _sheet in SHEETS:
    _over_sheets(
        f"s01_land_{_sheet}",
        lambda s, n=_sheet: raw_rows(s, n).drop("loaded_at"),
        f"select '{_sheet}' as sheet, 'batch-1' as import_batch_id, source_row_number, "
        f"{_json_object(_sheet)} as source_data from {_sheet}")


def _portable_sql(sheet: str) -> str:
    shown = []
    for column, declared, _ in SHEETS[sheet]:
        if declared == "integer":
            shown.append(f"cast({column} as bigint) as {column}")
        elif declared.startswith("decimal"):
            shown.append(f"cast({column} as double) as {column}")
        elif declared == "date":
            shown.append(f"cast({column} as varchar) as {column}")
        elif declared == "datetime":
            shown.append(f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {column}")
        else:
            shown.append(column)
    return f"'batch-1' as import_batch_id, source_row_number, {', '.join(shown)}"


for _letter, _sheet in zip("abdcef", ("products", "sales", "purchases", "inventory",
                                      "expedition", "vehicles")):
    _over_sheets(
        f"s05{_letter}_stage_{_sheet}",
        lambda s, n=_sheet: staging.stage(raw_rows(s, n), n),
        f"select {_portable_sql(_sheet)} from {_sheet}")


def _all_raw(sheets):
    out = None
    for name in SHEETS:
        rows = raw_rows(sheets, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def _stored_raw(sheets):
    """Append to a partitioned table and read a batch back."""
    spark = sheets.vehicles.sparkSession
    path = f"{shared_dir(spark)}/tidemark/raw-{uuid.uuid4().hex}"
    for name in SHEETS:
        landing.append_raw(raw_rows(sheets, name), path)
    return landing.read_raw(spark, path, "batch-1")


_SHEET_COUNTS = " union all ".join(
    f"select '{n}' as sheet, count(*) as n from {n}" for n in SHEETS)
_over_sheets("s04_append_raw",
             lambda s: _stored_raw(s).groupBy("import_batch_id", "sheet").agg(
                 F.count("*").alias("row_count"), F.min("source_row_number").alias("first_row"),
                 F.max("source_row_number").alias("last_row")),
             " union all ".join(
                 f"select 'batch-1' as import_batch_id, '{n}' as sheet, count(*) as row_count, "
                 f"min(source_row_number) as first_row, max(source_row_number) as last_row "
                 f"from {n}" for n in SHEETS))
_over_sheets("s06_completeness",
             lambda s: staging.completeness(_all_raw(s), s),
             f"select sheet, n as raw_rows, n as staging_rows, true as complete "
             f"from ({_SHEET_COUNTS})")
_over_sheets("s07_sheet_row_counts",
             lambda s: audit.sheet_row_counts(_all_raw(s)),
             f"""select 'batch-1' as import_batch_id, '{{' || string_agg('"' || sheet || '":' ||
             n, ',' order by sheet) || '}}' as sheet_row_counts from ({_SHEET_COUNTS})""")


def _files(tables):
    return tables("documents").select(
        F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("file_sha256"),
        F.octet_length("text").cast("bigint").alias("file_size_bytes"), "lang")


_over_tables(
    "s03_new_content",
    lambda t: landing.new_files(_files(t).drop("lang"), _files(t).where("lang = 'en'")),
    """select sha256(text) as file_sha256, min(cast(doc_id as varchar)) as path,
    cast(max(octet_length(encode(text))) as bigint) as file_size_bytes from documents
    where sha256(text) not in (select sha256(text) from documents where lang = 'en')
    group by 1""")
_RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _fingerprints(spark, directory):
    """S03 on the files of the relational tables."""
    files = landing.fingerprints(configure(spark), [f"{directory}/{name}.parquet" for name in _RELATIONAL])
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "file_sha256", "file_size_bytes")


WITHOUT_ORACLE = {"s03_file_fingerprints": _fingerprints}   # SQL over tables does not see their files
_over_tables(
    "s08_metadata_merge",
    lambda t: t("events").select("event_id", audit.merged(F.array(
        F.expr("map('type', event_type, 'user', cast(user_id as string))"),
        F.from_json("props", "map<string,string>"),
        F.expr("case when event_id % 2 = 0 then map('type', 'replaced') "
               "else cast(map() as map<string,string>) end"))).alias("m")).select(
        "event_id", *[F.element_at("m", k).alias(k) for k in ("type", "user", "k")],
        F.size("m").alias("entries")),
    """select event_id, case when event_id % 2 = 0 then 'replaced' else event_type end as type,
    cast(user_id as varchar) as user, json_extract_string(props, '$.k') as k,
    cast(3 as bigint) as entries from events""")

# --- S09 - S18: batch records; a customer is a batch, its orders are the events -------------------

_STATUS = ("case o_orderkey % 7 when 0 then 'registered' when 1 then 'validating' when 2 then "
           "'raw_loaded' when 3 then 'staging_loaded' when 4 then 'completed' when 5 then "
           "'rejected' else 'failed' end")


def _events(tables):
    nothing = {"batch_seq": "bigint", "original_filename": "string", "source_path": "string",
               "file_size_bytes": "bigint", "created_by": "string", "error_message": "string",
               "warning_count": "bigint"}
    return tables("orders").selectExpr(
        "cast(o_custkey as string) as batch_id", "o_orderkey as event_seq",
        f"{_STATUS} as status", "o_orderdate as at",
        "sha2(cast(o_custkey as string), 256) as file_sha256",
        "case when o_orderkey % 2 = 0 then cast(floor(o_totalprice) as bigint) end "
        "as row_count_raw",
        "case when o_orderkey % 3 = 0 then cast(floor(o_totalprice) as bigint) end "
        "as row_count_core",
        "case when o_orderkey % 5 = 0 then o_orderkey % 50 - 10 end as error_count",
        "map(o_orderpriority, o_orderstatus) as metadata",
        *[f"cast(null as {kind}) as {name}" for name, kind in nothing.items()])


_BATCHES_SQL = f"""(select cast(o_custkey as varchar) as batch_id, arg_max({_STATUS}, o_orderkey)
    as status, min(o_orderdate) as started_at, max(o_orderdate) filter (where o_orderkey % 7 in
    (4, 5, 6)) as finished_at, sha256(cast(o_custkey as varchar)) as file_sha256,
    arg_max(cast(floor(o_totalprice) as bigint), o_orderkey) filter (where o_orderkey % 2 = 0)
      as row_count_raw,
    arg_max(cast(floor(o_totalprice) as bigint), o_orderkey) filter (where o_orderkey % 3 = 0)
      as row_count_core,
    arg_max(o_orderkey % 50 - 10, o_orderkey) filter (where o_orderkey % 5 = 0)
      as error_count
    from orders group by o_custkey)"""
_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"

_over_tables(
    "s09_batch_state",
    lambda t: audit.batches(_events(t)).select(
        "batch_id", "status", "started_at", "finished_at", "row_count_raw", "row_count_core",
        "error_count", "metadata"),
    f"""select b.batch_id, status, {_TIME.format('started_at')}, {_TIME.format('finished_at')},
    row_count_raw, row_count_core, error_count, metadata from {_BATCHES_SQL} b join
    (select batch_id, '{{' || string_agg('"' || k || '":"' || v || '"', ',' order by k) || '}}'
     as metadata from (select cast(o_custkey as varchar) as batch_id, o_orderpriority as k,
     arg_max(o_orderstatus, o_orderkey) as v from orders group by all) group by 1) m
    using (batch_id)""")
_over_tables(
    "s09a_batches_ready_for_core",
    lambda t: audit.in_status(audit.batches(_events(t)), "core").select("batch_id", "status"),
    f"select batch_id, status from {_BATCHES_SQL} where status = 'staging_loaded'")
_over_tables(
    "s18_batch_listing", lambda t: audit.batch_listing(audit.batches(_events(t))),
    f"""select batch_id, status, cast(null as varchar) as original_filename, row_count_raw,
    row_count_core, error_count, cast(null as bigint) as warning_count,
    {_TIME.format('started_at')}, {_TIME.format('finished_at')} from {_BATCHES_SQL}""")
_over_tables(
    "s18a_batch_totals", lambda t: audit.batch_totals(audit.batches(_events(t))),
    f"""select count(*) as batch_count, cast(sum(row_count_raw) as bigint) as raw_rows,
    cast(sum(row_count_core) as bigint) as core_rows from {_BATCHES_SQL}""")
_over_tables(
    "constraint_batch_domains",
    lambda t: audit.batch_violations(audit.batches(_events(t))).select("batch_id", "error_count"),
    f"""select batch_id, error_count from {_BATCHES_SQL} where row_count_raw < 0 or
    row_count_core < 0 or error_count < 0 or finished_at < started_at
    or not regexp_full_match(file_sha256, '[0-9a-f]{{64}}')""")
_over_tables(
    "s13_key_value_pivot",
    lambda t: audit.pivoted(t("part").select(F.col("p_type").alias("key"),
                                             F.col("p_name").alias("value")),
                            ["ECONOMY", "STANDARD", "absent"]),
    """select max(p_name) filter (where p_type = 'ECONOMY') as "ECONOMY",
    max(p_name) filter (where p_type = 'STANDARD') as "STANDARD",
    max(p_name) filter (where p_type = 'absent') as absent from part""")


def _core_layer(s):
    suppliers = core_load.suppliers(s, None, "batch-1")
    return {
        "customers": (core_load.customers(s, "batch-1"), "source_import_batch_id"),
        "products": (core_load.products(s, suppliers), "source_import_batch_id"),
        "vehicles": (core_load.vehicles(s), "source_import_batch_id"),
        "sales_order_lines": (core_load.sales_order_lines(s), "source_import_batch_id"),
        "expeditions": (core_load.expeditions(s), "source_import_batch_id"),
    }


def _layers(s):
    return audit.layer_counts({
        "raw": {n: (raw_rows(s, n), "import_batch_id") for n in SHEETS},
        "staging": {n: (df, "import_batch_id") for n, df in s.items()},
        "core": _core_layer(s)})


_LAYER_SQL = " union all ".join(
    [f"select '{layer}' as layer, '{n}' as tbl, count(*) as n from {n}"
     for layer in ("raw", "staging") for n in SHEETS]
    + [f"select 'core' as layer, '{t}' as tbl, {n} as n from {src}" for t, n, src in (
        ("customers", "count(distinct customer_id)", "sales"), ("products", "count(*)", "products"),
        ("vehicles", "count(*)", "vehicles"), ("sales_order_lines", "count(*)", "sales"),
        ("expeditions", "count(*)", "expedition"))])
_over_sheets("s10_layer_counts", _layers, f"""
    select 'batch-1' as batch_id, layer, tbl as "table", cast(sum(n) as bigint) as row_count
    from ({_LAYER_SQL}) group by grouping sets ((layer, tbl), (layer))""")
_RULE_ISSUES = " union all ".join(
    f"select '{code}' as rule_code {rest}" for (code, _), (_, _, rest) in RULE_SQL.items()
    if not code.startswith("CORE"))
_over_sheets("s11_issue_summary", lambda s: audit.issue_summary(rules.all_issues(s, None)),
             f"""select 'ERROR' as severity, rule_code, count(*) as issue_count
             from ({_RULE_ISSUES}) group by rule_code""")


def _report(s):
    issues = rules.all_issues(s, None).withColumn("import_batch_id", F.lit("batch-1"))
    batch = s.sales.groupBy(F.col("import_batch_id").alias("batch_id")).agg(
        F.lit("rejected").alias("status"), F.min("order_date").alias("first_date"))
    doc = audit.batch_report(batch, _layers(s), issues)
    pick = lambda path: F.get_json_object("report", path)
    return doc.select(
        "batch_id", pick("$.batch.status").alias("status"),
        pick("$.batch.first_date").alias("first_date"),
        *[pick(f"$.row_counts.{layer}.total").cast("bigint").alias(f"{layer}_total")
          for layer in ("raw", "staging", "core")],
        pick("$.row_counts.raw.tables.sales").cast("bigint").alias("raw_sales"),
        pick("$.issues[0].rule_code").alias("first_code"),
        pick("$.issues[0].count").cast("bigint").alias("first_count"))


_over_sheets("s17_batch_report", _report, f"""
    select 'batch-1' as batch_id, 'rejected' as status,
           (select cast(min(order_date) as varchar) from sales) as first_date,
           {', '.join(f"(select cast(sum(n) as bigint) from ({_LAYER_SQL}) where layer = '{l}')"
                      f" as {l}_total" for l in ('raw', 'staging', 'core'))},
           (select count(*) from sales) as raw_sales, rule_code as first_code,
           count(*) as first_count from ({_RULE_ISSUES}) group by rule_code
    order by rule_code limit 1""")

# --- C01 - C15, P07, P08 --------------------------------------------------------------------------

_DICTIONARY = ("case when doc_id % 11 = 0 then '' else lang end as sheet_name",
               "case when doc_id % 13 = 0 then null else source end as column_name",
               "concat(' ', upper(lang), ' ') as data_type",
               "case doc_id % 7 when 0 then 'áno' when 1 then 'ANO ' when 2 then 'yes' "
               "when 3 then ' True' when 4 then '1' when 5 then 'nie' end as required",
               "case when doc_id % 3 = 0 then cast(doc_id as {text}) end as description")


def _dictionary(tables):
    return tables("documents").selectExpr(*[d.format(text="string") for d in _DICTIONARY])


_DICTIONARY_SQL = ("(select " + ", ".join(d.format(text="varchar") for d in _DICTIONARY)
                   + " from documents)")
_over_tables("c01_read_contract", lambda t: contract.read_contract(_dictionary(t)), f"""
    select sheet_name, column_name, lower(trim(data_type)) as data_type,
           coalesce(lower(trim(required)) in ('áno', 'ano', 'yes', 'true', '1'), false)
             as required, description
    from {_DICTIONARY_SQL} where sheet_name <> '' and column_name <> ''""")
_over_tables("p08_list_contract", lambda t: contract.list_contract(_dictionary(t)), f"""
    select {', '.join(f"coalesce({c}, '') as {c}" for c in
                      ('sheet_name', 'column_name', 'data_type', 'required', 'description'))}
    from {_DICTIONARY_SQL}""")

_STRUCTURE = [ContractColumn(s, c, "text", True) for s, cs in (
    ("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    ("orders", ("o_orderkey", "o_custkey", "o_status", "o_totalprice")),
    ("supplier", ("s_name", "s_suppkey", "s_nationkey", "s_acctbal")),
    ("warehouse", ("w_id",))) for c in cs]
_over_tables(
    "c02_structure",
    lambda t: contract.structure_with_rows(
        {n: t(n) for n in ("part", "orders", "supplier")}, _STRUCTURE),
    """select 'part' as sheet, 'OK' as status, '' as missing, '' as extra, '' as duplicates,
       true as order_matches, count(*) as data_rows from part
    union all select 'orders', 'DIFFERENT', 'o_status',
       'o_orderstatus,o_orderdate,o_orderpriority', '', false, count(*) from orders
    union all select 'supplier', 'DIFFERENT', '', '', '', false, count(*) from supplier
    union all select 'warehouse', 'MISSING', 'w_id', '', '', false, 0""")

# Columns of the tables under contracts they partly break.
_VALUE_CONTRACT = [
    ContractColumn("lineitem", "l_orderkey", "integer", True),
    ContractColumn("lineitem", "l_quantity", "integer", True),
    ContractColumn("lineitem", "l_returnflag", "integer", True),
    ContractColumn("lineitem", "l_linestatus", "decimal(5,2)", True),
    ContractColumn("lineitem", "l_extendedprice", "decimal(6,1)", True),
    ContractColumn("lineitem", "l_discount", "decimal(3,2)", True),
    ContractColumn("lineitem", "l_shipdate", "date", True),
    ContractColumn("orders", "o_custkey", "text", True),
    ContractColumn("orders", "o_orderpriority", "date", True),
    ContractColumn("orders", "o_orderstatus", "datetime", True),
    ContractColumn("orders", "o_orderdate", "datetime", True),
    ContractColumn("orders", "o_totalprice", "money", False),
    ContractColumn("documents", "text", "text", True),
    ContractColumn("documents", "lang", "text", True),
    ContractColumn("documents", "source", "text", False),
    ContractColumn("documents", "n_chars", "integer", True),
]


def _value_sheets(tables):
    number = landing.numbered_by_position
    docs = number(tables("documents"))
    return {
        "lineitem": number(tables("lineitem")),
        "orders": number(tables("orders")),
        "documents": docs.selectExpr(
            "source_row_number", "text",
            "case when doc_id % 17 = 0 then null when doc_id % 19 = 0 then '  ' "
            "when doc_id % 23 = 0 then lang || ' ' else lang end as lang",
            "case when doc_id % 29 = 0 then '=' || source else source end as source",
            "n_chars"),
    }


_VALUE_SOURCES = {
    "lineitem": "(select *, row_number() over () + 1 as rn from lineitem)",
    "orders": "(select *, row_number() over () + 1 as rn from orders)",
    "documents": """(select rn, text, n_chars, case when doc_id % 17 = 0 then null
        when doc_id % 19 = 0 then '  ' when doc_id % 23 = 0 then lang || ' ' else lang end
        as lang, case when doc_id % 29 = 0 then '=' || source else source end as source from
        (select *, row_number() over () + 1 as rn from documents))""",
}
_BLANK = "regexp_full_match({}, '\\s*')"
_EDGE = "regexp_matches({}, '^\\s|\\s$')"
# code -> (sheet, column, message, violation)
_VALUE_SQL = {
    "REQUIRED_VALUE_MISSING": [
        ("documents", c, "'povinna hodnota chyba'", f"{c} is null or {_BLANK.format(c)}")
        for c in ("lang", "text")],
    "FORMULA_NOT_ALLOWED": [
        ("documents", c, "'data obsahujú Excel formulu namiesto hodnoty'", f"{c} like '=%'")
        for c in ("source", "text")],
    "TEXT_SURROUNDING_WHITESPACE": [
        ("documents", c, "'text obsahuje medzeru na zaciatku alebo konci'",
         f"not {_BLANK.format(c)} and {_EDGE.format(c)}") for c in ("lang", "source", "text")],
    "INVALID_TEXT": [("orders", "o_custkey", "'ocakavany text, ziskany typ int'", "true")],
    "INVALID_INTEGER": [("lineitem", "l_returnflag",
                         "'ocakavane cele cislo, ziskany typ str'", "true")],
    "INVALID_DECIMAL": [("lineitem", "l_linestatus",
                         "'ocakavane desatinne cislo, ziskany typ str'", "true")],
    "DECIMAL_SCALE_EXCEEDED": [
        ("lineitem", "l_extendedprice", "'hodnota ma viac ako 1 desatinnych miest'",
         "cast(l_extendedprice as decimal(18,6)) * 10 <> "
         "floor(cast(l_extendedprice as decimal(18,6)) * 10)")],
    "DECIMAL_PRECISION_EXCEEDED": [
        ("lineitem", "l_extendedprice", "'hodnota sa nezmesti do decimal(6,1)'",
         "l_extendedprice >= 100000")],
    "INVALID_DATE": [("orders", "o_orderpriority", "'ocakavany datum, ziskany typ str'",
                      "true")],
    "INVALID_DATETIME": [("orders", "o_orderstatus", "'ocakavany datetime, ziskany typ str'",
                          "true")],
    "UNKNOWN_CONTRACT_TYPE": [("orders", "o_totalprice", "'neznamy deklarovany typ money'",
                               "true")],
}


def _value_sql(code: str) -> str:
    level = "WARNING" if code == "TEXT_SURROUNDING_WHITESPACE" else "ERROR"
    return " union all ".join(
        f"select '{level}' as level, '{code}' as code, '{sheet}' as sheet, rn as "
        f"source_row_number, '{column}' as \"column\", {message} as message "
        f"from {_VALUE_SOURCES[sheet]} where {violation}"
        for sheet, column, message, violation in _VALUE_SQL[code])


def _value_issues(tables, code: str | None = None):
    sheets = _value_sheets(tables)
    wanted = sheets if code is None else {s for s, *_ in _VALUE_SQL[code]}
    out = None
    for name in sheets:
        if name in wanted:
            found = contract.value_issues(sheets[name], name, _VALUE_CONTRACT)
            out = found if out is None else out.unionByName(found)
    return out if code is None else out.where(F.col("code") == code)


for _number, _code in zip(("c03", "c04", "c05", "c06", "c07", "c08", "c09", "c10", "c11", "c12",
                           "c13"), _VALUE_SQL):
    _over_tables(f"{_number}_{_code.lower()}", lambda t, c=_code: _value_issues(t, c),
                 _value_sql(_code))

_ALL_VALUES = " union all ".join(_value_sql(code) for code in _VALUE_SQL)
_over_tables(
    "c14_value_rollup",
    lambda t: contract.issue_rollup(
        _value_issues(t), ["sheet", "source_row_number", "column"],
        F.concat("sheet", F.lit("!"), "column", F.col("source_row_number").cast("string")))
    .select("level", "code", "issue_count", F.array_join("examples", " ").alias("examples")),
    f"""select level, code, max(n) as issue_count, string_agg(sheet || '!' || "column" ||
        source_row_number, ' ' order by rk) as examples from (select *, count(*) over
        (partition by level, code) as n, row_number() over (partition by level, code order by
        sheet, source_row_number, "column") as rk from ({_ALL_VALUES})) where rk <= 10
        group by level, code""")
_over_tables(
    "c15_value_totals",
    lambda t: contract.value_totals(_value_sheets(t), _VALUE_CONTRACT, _value_issues(t)),
    f"""select cast(l + o + d as bigint) as total_rows, cast(l * 7 + o * 5 + d * 4 as bigint)
        as values_checked, e as error_count, w as warning_count, e = 0 as valid from
        (select (select count(*) from lineitem) as l, (select count(*) from orders) as o,
         (select count(*) from documents) as d,
         (select count(*) from ({_ALL_VALUES}) where level = 'ERROR') as e,
         (select count(*) from ({_ALL_VALUES}) where level = 'WARNING') as w)""")


def _json_issues(tables):
    """Token types of JSON rows: a number where text is declared, too many digits."""
    raw = tables("events").select(
        F.lit("events").alias("sheet"), F.col("event_id").alias("source_row_number"),
        F.col("props").alias("source_data"))
    sheet = contract.variant_sheet(raw, "events", ["k"])
    found = [contract.value_issues(sheet, "events", [ContractColumn("events", "k", kind, True)])
             for kind in ("text", "decimal(1,0)")]
    return found[0].unionByName(found[1])


_over_tables("c06a_json_token_types", _json_issues, """
    select 'ERROR' as level, 'INVALID_TEXT' as code, 'events' as sheet, event_id as
           source_row_number, 'k' as "column", 'ocakavany text, ziskany typ int' as message
    from events where json_type(props, '$.k') <> 'VARCHAR'
    union all select 'ERROR', 'DECIMAL_PRECISION_EXCEEDED', 'events', event_id, 'k',
           'hodnota sa nezmesti do decimal(1,0)' from events
    where cast(json_extract(props, '$.k') as bigint) >= 10""")
_over_tables(
    "p07_preview",
    lambda t: profiles.preview(landing.numbered_by_position(t("orders"), first_rows=3)),
    """select rn as source_row_number, cast(o_orderkey as varchar) as o_orderkey,
    cast(o_custkey as varchar) as o_custkey, o_orderstatus, cast(o_totalprice as varchar) as
    o_totalprice, cast(o_orderdate as varchar) as o_orderdate, o_orderpriority from
    (select *, row_number() over () + 1 as rn from orders) where rn <= 3""")
_over_tables(
    "p07a_dimensions",
    lambda t: profiles.dimensions({n: t(n) for n in ("part", "orders", "lineitem")}),
    """select 'part' as sheet, count(*) + 1 as max_row, cast(6 as bigint) as max_column from part
    union all select 'orders', count(*) + 1, 6 from orders
    union all select 'lineitem', count(*) + 1, 11 from lineitem""")

# --- P01 - P06, P09 -------------------------------------------------------------------------------


def _orphans(child: str, parent: str, column: str, extra: str = "true") -> str:
    return (f"(select count(*) from {child} where {extra} and {column} not in "
            f"(select {column} from {parent}))")


_over_sheets("p01_product_profile", profiles.products, """
    select count(distinct product_id) as product_count,
           count(*) - count(distinct product_id) as product_id_duplicates,
           count(distinct category) as category_count,
           count(distinct supplier) as supplier_count from products""")
_over_sheets("p02_vehicle_profile", profiles.vehicles, """
    select count(distinct vehicle_id) as vehicle_count,
           count(*) - count(distinct vehicle_id) as vehicle_id_duplicates from vehicles""")
_over_sheets("p03_sales_profile", profiles.sales, f"""
    select count(*) as line_count, count(distinct order_id) as order_count,
           count(distinct customer_id) as customer_count,
           {_orphans('sales', 'products', 'product_id')} as product_fk_missing,
           cast(min(order_date) as varchar) as date_min,
           cast(max(order_date) as varchar) as date_max from sales""")
for _sheet, _column in (("sales", "region"), ("sales", "order_status"),
                        ("expedition", "delivery_type"), ("expedition", "region")):
    _over_sheets(
        f"{'p03a' if _sheet == 'sales' else 'p06a'}_{_sheet}_{_column}_histogram",
        lambda s, n=_sheet, c=_column: profiles.histogram(getattr(s, n), c),
        f"select {_column} as value, count(*) as row_count from {_sheet} group by 1")
_over_sheets("p04_inventory_profile", profiles.inventory, f"""
    select count(*) as row_count,
           count(*) - count(distinct (snapshot_date, product_id)) as key_duplicates,
           {_orphans('inventory', 'products', 'product_id')} as product_fk_missing,
           count(distinct snapshot_date) as snapshot_count,
           (select min(n) from (select count(*) as n from inventory group by snapshot_date))
             as rows_per_snapshot_min,
           (select max(n) from (select count(*) as n from inventory group by snapshot_date))
             as rows_per_snapshot_max,
           cast(min(snapshot_date) as varchar) as date_min,
           cast(max(snapshot_date) as varchar) as date_max,
           count(*) filter (where stock_available <> stock_actual - stock_reserved)
             as equation_errors,
           count(*) filter (where stock_reserved > stock_actual) as reserved_over_actual,
           count(*) filter (where min_stock > max_stock) as min_over_max from inventory""")
_over_sheets("p05_purchase_profile", profiles.purchases, f"""
    select count(*) as line_count, count(distinct purchase_order_id) as order_count,
           {_orphans('purchases', 'products', 'product_id')} as product_fk_missing,
           cast(min(order_date) as varchar) as date_min,
           cast(max(order_date) as varchar) as date_max,
           count(*) filter (where delivery_date < order_date) as delivery_before_order,
           count(*) filter (where delivered_quantity > ordered_quantity)
             as delivered_over_ordered from purchases""")
_over_sheets("p06_expedition_profile", profiles.expedition, f"""
    select count(*) as row_count, count(*) - count(distinct order_id) as order_duplicates,
           {_orphans('expedition', 'sales', 'order_id')} as order_fk_missing,
           {_orphans('expedition', 'vehicles', 'vehicle_id', 'vehicle_id is not null')}
             as vehicle_fk_missing,
           count(*) filter (where picked_at < received_at) as picked_before_received
    from expedition""")
_over_sheets("p09_validation_summary", profiles.summary, """
    select cast(min(order_date) as varchar) as sales_date_min,
           cast(max(order_date) as varchar) as sales_date_max,
           (select cast(min(order_date) as varchar) from purchases) as purchase_date_min,
           (select cast(max(order_date) as varchar) from purchases) as purchase_date_max,
           (select count(distinct product_id) from products) as product_count,
           count(distinct order_id) as sales_order_count,
           (select count(distinct purchase_order_id) from purchases) as purchase_order_count,
           (select count(distinct snapshot_date) from inventory) as inventory_snapshot_count,
           (select count(distinct order_id) from expedition) as expedition_order_count,
           (select count(distinct vehicle_id) from vehicles) as vehicle_count from sales""")

# --- K01 - K11, upsert, constraints ---------------------------------------------------------------

_NAMES = "(select supplier as n from products union select supplier from purchases)"
_IDS = (f"(select row_number() over (order by substr(md5(n), 1, 3), n) as id, n "
        f"from {_NAMES})")
_over_sheets("k01_suppliers", lambda s: core_load.suppliers(s, None, "batch-1"),
             f"select id, n as supplier_name, 'batch-1' as source_import_batch_id from {_IDS}")


def _known_suppliers(s):
    """Suppliers of the products are known already, those of the purchases are added."""
    first = core_load.suppliers(s.replace(purchases=s.purchases.limit(0)), None, "batch-0")
    return core_load.suppliers(s, first, "batch-1")


_over_sheets("k01a_suppliers_next_batch", _known_suppliers, """
    select id, n as supplier_name, 'batch-1' as source_import_batch_id from (
      select row_number() over (order by substr(md5(n), 1, 3), n) as id, n
      from (select distinct supplier as n from products)
      union all
      select (select count(distinct supplier) from products)
             + row_number() over (order by substr(md5(n), 1, 3), n), n
      from (select distinct supplier as n from purchases where supplier not in
            (select supplier from products)))""")
_over_sheets("k02_customers", lambda s: core_load.customers(s, "batch-1"), """
    select customer_id, min(customer_name) as customer_name, 'batch-1' as
           source_import_batch_id from sales group by 1""")


def _customer_upsert(spark, directory):
    existing = table(configure(spark), directory, "customer").selectExpr(
        "'C' || c_custkey as customer_id", "c_name as customer_name",
        "'batch-0' as source_import_batch_id")
    incoming = core_load.customers(flawed_sheets(spark, directory), "batch-1")
    return portable(upsert(existing, incoming, ["customer_id"]))


QUERIES["k02a_customers_upsert"] = _customer_upsert
ORACLE["k02a_customers_upsert"] = over_sheets("""
    select coalesce(s.customer_id, e.customer_id) as customer_id,
           coalesce(s.customer_name, e.c_name) as customer_name,
           case when s.customer_id is null then 'batch-0' else 'batch-1' end
             as source_import_batch_id
    from (select 'C' || c_custkey as customer_id, c_name from customer) e full join
         (select customer_id, min(customer_name) as customer_name from sales group by 1) s
         using (customer_id)""")


def _with_suppliers(plan):
    return lambda s: plan(s, core_load.suppliers(s, None, "batch-1"))


def _shown(columns: list[str], sheet: str) -> str:
    kinds = {c: t for c, t, _ in SHEETS[sheet]}
    out = []
    for c in columns:
        kind = kinds.get(c, "text")
        if kind == "integer":
            out.append(f"cast({c} as bigint) as {c}")
        elif kind.startswith("decimal"):
            out.append(f"cast({c} as double) as {c}")
        elif kind == "date":
            out.append(f"cast({c} as varchar) as {c}")
        elif kind == "datetime":
            out.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}")
        else:
            out.append(c)
    return ", ".join(out)


_BATCH = "'batch-1' as source_import_batch_id"
_over_sheets("k03_products", _with_suppliers(core_load.products), f"""
    select {_shown([c for c in _columns('products') if c != 'supplier'], 'products')},
           id as supplier_id, {_BATCH}, source_row_number
    from products join {_IDS} i on i.n = products.supplier""")
_over_sheets("k04_vehicles", core_load.vehicles,
             f"select {_shown(_columns('vehicles'), 'vehicles')}, {_BATCH}, source_row_number "
             "from vehicles")
_HEADER = ["order_id", "order_date", "customer_id", "region", "order_status", "expedition_date"]
_over_sheets("k05_sales_orders", core_load.sales_orders,
             f"select distinct {_shown(_HEADER, 'sales')}, {_BATCH} from sales")
_over_sheets("k06_sales_order_lines", core_load.sales_order_lines, f"""
    select {_shown(['order_id', 'product_id', 'quantity', 'unit_price'], 'sales')},
           row_number() over (partition by order_id order by source_row_number) as line_number,
           {_BATCH}, source_row_number from sales""")
_over_sheets("k07_purchase_orders", _with_suppliers(core_load.purchase_orders), f"""
    select distinct {_shown(['purchase_order_id', 'order_date'], 'purchases')},
           id as supplier_id, {_BATCH} from purchases join {_IDS} i on i.n = supplier""")
_over_sheets("k08_purchase_order_lines", core_load.purchase_order_lines, f"""
    select {_shown(['purchase_order_id', 'delivery_date', 'product_id', 'ordered_quantity',
                    'delivered_quantity', 'purchase_price'], 'purchases')},
           row_number() over (partition by purchase_order_id order by source_row_number)
             as line_number, cast(0 as bigint) as batch_seq, {_BATCH}, source_row_number
    from purchases""")
_DAY = "cast(snapshot_date - date '1970-01-01' as bigint)"
_over_sheets("k09_inventory_snapshots", core_load.inventory_snapshots,
             f"select distinct {_DAY} as id, {_shown(['snapshot_date'], 'inventory')}, {_BATCH} "
             "from inventory")
_over_sheets("k10_inventory_snapshot_lines", core_load.inventory_snapshot_lines, f"""
    select {_DAY} as snapshot_id,
           {_shown([c for c in _columns('inventory') if c != 'snapshot_date'], 'inventory')},
           {_BATCH}, source_row_number from inventory""")
_over_sheets("k11_expeditions", core_load.expeditions,
             f"select {_shown(_columns('expedition'), 'expedition')}, {_BATCH}, "
             "source_row_number from expedition")
_over_tables("constraint_unique_keys",
             lambda t: audit.key_violations(t("lineitem"), ("l_orderkey", "l_linenumber")),
             """select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, count(*) as
             row_count from lineitem group by 1, 2 having count(*) > 1""")
_over_sheets("constraint_references",
             lambda s: audit.reference_violations(s.sales, "product_id", s.products, "product_id")
             .select("source_row_number", "product_id"),
             """select source_row_number, product_id from sales where product_id not in
             (select product_id from products)""")
_over_sheets("constraint_not_null",
             lambda s: audit.null_counts(s.expedition, _columns("expedition")),
             "select " + ", ".join(f"count(*) filter (where {c} is null) as {c}"
                                   for c in _columns("expedition")) + " from expedition")
_over_sheets("constraint_issue_domains",
             lambda s: audit.issue_violations(rules.row_rule_issues(s, "sales").withColumn(
                 "source_row_number", F.col("source_row_number") - 1000)).select(
                 "rule_code", "source_row_number"),
             "select rule_code, source_row_number - 1000 as source_row_number from ("
             + " union all ".join(
                 f"select '{code}' as rule_code, source_row_number {rest}"
                 for (code, sheet), (_, _, rest) in RULE_SQL.items()
                 if (code, sheet) in rules.ROW_RULES and sheet == "sales")
             + ") where source_row_number - 1000 < 2")


# --- the constraints an import holds its rows against ---------------------------------------------

def _violations_sql(parts: list[tuple[str, str, str, str]]) -> str:
    return "select * from (" + " union all ".join(
        f"select '{t}' as table_name, '{rule}' as rule, '{c}' as columns, count(*) as violations {rest}"
        for t, rule, c, rest in parts) + ") where violations > 0"


_over_sheets("constraint_staging_keys", importing.staging_violations, _violations_sql([
    *[(n, "not null", c, f"from {n} where {c} is null")
      for n, columns in SHEETS.items() for c, _, nullable in columns if not nullable],
    *[(n, "unique", ",".join(k), f"from (select 1 from {n} group by {', '.join(k)} having count(*) > 1)")
      for n, k in SHEET_KEYS.items()]]))

# A core with flaws: shipments by own vehicles come twice; some products and vehicles are unknown.
_SHIPPED = "(select * from expeditions union all select * from expeditions where kind = 'own')"
_FLAWED_PARENTS = {"products": "(select * from products where product_id % 5 <> 0)",
                   "vehicles": "(select * from vehicles where capacity_kg > 800)"}


def _core_violations(spark, directory):
    core = core_from_tables(configure(spark), directory)
    shipped = core.expeditions.unionByName(core.expeditions.where(F.col("vehicle_id").isNotNull()))
    new = core.replace(expeditions=shipped)
    known = new.replace(products=core.products.where("product_id % 5 <> 0"),
                        vehicles=core.vehicles.where("capacity_kg > 800"))
    return portable(importing.core_violations(new, known))


def _core_reference(child, column, parent, parent_column):
    if child == "inventory_snapshot_lines" and parent == "inventory_snapshots":
        column, parent_column = "snapshot_date", "snapshot_date"
    rows = _SHIPPED if child == "expeditions" else child
    return (f"from {rows} where {column} is not null and {column} not in "
            f"(select {parent_column} from {_FLAWED_PARENTS.get(parent, parent)})")


def _core_key(name, keys):
    keys = ("snapshot_date", "product_id") if name == "inventory_snapshot_lines" else keys
    rows = _SHIPPED if name == "expeditions" else name
    return f"from (select 1 from {rows} group by {', '.join(keys)} having count(*) > 1)"


QUERIES["constraint_core_rows"] = _core_violations
ORACLE["constraint_core_rows"] = over_core(_violations_sql([
    *[(n, "unique", ",".join(k), _core_key(n, k)) for n, k in CORE_KEYS.items()],
    *[(c, "reference", column, _core_reference(c, column, p, pc)) for c, column, p, pc in CORE_REFERENCES]]))

_over_tables("s02_header_guard",
             lambda t: landing.header_problems(t("part").selectExpr(
                 "'size ' || p_size as sheet", "case when p_partkey % 50 = 1 then ' ' else p_type end as name")
                 .withColumn("name", F.nullif(F.trim("name"), F.lit("")))),
             """select sheet, name, count(*) as n from (select 'size ' || p_size as sheet,
             case when p_partkey % 50 = 1 then '' else p_type end as name from part)
             group by all having count(*) > 1 or name = ''""")


def _revalidated(spark, directory):
    """The issues of a batch are written twice; the second time replaces the first."""
    sheets = flawed_sheets(configure(spark), directory)
    path = f"{shared_dir(spark)}/tidemark/issues-{uuid.uuid4().hex}/import_batch_id=batch-1"
    for _ in range(2):
        rules.all_issues(sheets, gate_core(spark, directory)).write.mode("overwrite").parquet(path)
    return portable(audit.issue_summary(spark.read.parquet(path)))


QUERIES["k13_revalidation"] = _revalidated
ORACLE["k13_revalidation"] = RULE_ORACLE["k12_rule_gate"]
