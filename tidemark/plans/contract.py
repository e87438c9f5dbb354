"""Checks of input sheets against their data contract.

A contract is metadata: at most a few hundred (sheet, column, type, required) entries.  It is
compiled into column expressions, so that a sheet of any size is checked in one scan without a
join or a shuffle, and only offending cells produce rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import REQUIRED_WORDS, SHEETS
from tidemark.operators.findings import explode_where

# --- fixed values: codes, messages, limits -------------------------------------------------------
DECIMAL_TYPE = r"^decimal\((\d+),(\d+)\)$"
MESSAGES = {
    "REQUIRED_VALUE_MISSING": "povinna hodnota chyba",
    "FORMULA_NOT_ALLOWED": "data obsahujú Excel formulu namiesto hodnoty",
    "TEXT_SURROUNDING_WHITESPACE": "text obsahuje medzeru na zaciatku alebo konci",
    "INVALID_TEXT": "ocakavany text, ziskany typ ",
    "INVALID_INTEGER": "ocakavane cele cislo, ziskany typ ",
    "INVALID_DECIMAL": "ocakavane desatinne cislo, ziskany typ ",
    "DECIMAL_SCALE_EXCEEDED": "hodnota ma viac ako {scale} desatinnych miest",
    "DECIMAL_PRECISION_EXCEEDED": "hodnota sa nezmesti do decimal({precision},{scale})",
    "INVALID_DATE": "ocakavany datum, ziskany typ ",
    "INVALID_DATETIME": "ocakavany datetime, ziskany typ ",
    "UNKNOWN_CONTRACT_TYPE": "neznamy deklarovany typ ",
}
VALUE_EXAMPLES = 10
BUSINESS_EXAMPLES = 20
# -------------------------------------------------------------------------------------------------
# white space at the ends of a text
_SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
           + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000")
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"
_ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
_INTEGER = "^[+-]?[0-9]+$"
_NUMBER = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_WIDE = "decimal(38,18)"


@dataclass(frozen=True)
class ContractColumn:
    sheet: str
    column: str
    declared: str
    required: bool
    description: str | None = None


def default_contract() -> list[ContractColumn]:
    """The contract of the six sheets."""
    return [ContractColumn(sheet, name, declared, not nullable)
            for sheet, columns in SHEETS.items() for name, declared, nullable in columns]


def read_contract(dictionary: DataFrame) -> DataFrame:
    """Usable dictionary rows with a normalized type and a yes/no ``required``."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
             for c in ("sheet_name", "column_name")]

    def normal(column: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("None"))))

    return dictionary.where(named[0] & named[1]).select(
        "sheet_name", "column_name", normal("data_type").alias("data_type"),
        normal("required").isin(*REQUIRED_WORDS).alias("required"), "description")


def compiled(dictionary: DataFrame) -> list[ContractColumn]:
    """The contract as a list on the driver, to build expressions from."""
    return [ContractColumn(*row) for row in read_contract(dictionary).collect()]


def list_contract(dictionary: DataFrame) -> DataFrame:
    """The dictionary as it stands, missing cells as empty text."""
    return dictionary.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in dictionary.columns])


# --- C02: structure -------------------------------------------------------------------------------

def structure(headers: dict[str, list[str | None]], contract: list[ContractColumn]
              ) -> list[dict[str, object]]:
    """Header differences per contract sheet (metadata only)."""
    report = []
    for sheet in dict.fromkeys(c.sheet for c in contract):
        expected = [c.column for c in contract if c.sheet == sheet]
        if sheet not in headers:
            report.append({"sheet": sheet, "status": "MISSING", "missing": expected,
                           "extra": [], "duplicates": [], "order_matches": False})
            continue
        actual = ["" if name is None else str(name) for name in headers[sheet]]
        duplicates = sorted({n for n in actual if n and actual.count(n) > 1})
        entry = {
            "sheet": sheet,
            "missing": [n for n in expected if n not in actual],
            "extra": [n for n in actual if n not in expected],
            "duplicates": duplicates,
            "order_matches": actual == expected,
        }
        clean = entry["order_matches"] and not duplicates
        report.append({"status": "OK" if clean else "DIFFERENT", **entry})
    return report


def structure_with_rows(sheets: dict[str, DataFrame], contract: list[ContractColumn]
                        ) -> DataFrame:
    """C02 as a table: one row per contract sheet with its number of data rows."""
    entries = structure({name: df.columns for name, df in sheets.items()}, contract)
    parts = []
    for entry in entries:
        fixed = [F.lit(entry["sheet"]).alias("sheet"), F.lit(entry["status"]).alias("status"),
                 *[F.lit(",".join(entry[k])).alias(k)
                   for k in ("missing", "extra", "duplicates")],
                 F.lit(entry["order_matches"]).alias("order_matches")]
        if entry["sheet"] in sheets:
            parts.append(sheets[entry["sheet"]].agg(F.count("*").alias("data_rows"))
                         .select(*fixed, "data_rows"))
    present = reduce(DataFrame.unionByName, parts)
    absent = [e for e in entries if e["sheet"] not in sheets]
    if absent:
        rows = [(e["sheet"], e["status"], ",".join(e["missing"]), "", "", False, 0)
                for e in absent]
        present = present.unionByName(
            present.sparkSession.createDataFrame(rows, present.schema))
    return present


# --- C03 - C13: values ----------------------------------------------------------------------------

@dataclass(frozen=True)
class _Cell:
    """A cell as the checks see it."""

    kind: Column    # str, int, float, bool, date, datetime; null for an empty cell
    text: Column    # the text of a text cell, else null
    digits: Column  # a number in its shortest notation as text, else null
    double: Column  # double of a number, else null
    decimal: Column | None = None   # the cell itself where its column is a decimal

    def whole(self) -> Column:
        """A number without decimal places, exactly; exponents are those of doubles."""
        if self.decimal is not None:
            return F.round(self.decimal, 0) == self.decimal
        return F.when(self.digits.contains("E"), F.floor(self.double) == self.double).otherwise(
            ~self.digits.rlike("[.][0-9]*[1-9]"))

    def beyond(self, places: int) -> Column:
        """More than ``places`` digits before the decimal point, exactly."""
        if self.decimal is not None:
            return F.abs(self.decimal) >= F.lit(Decimal(10 ** places))
        digits = F.length(F.regexp_extract(self.digits, "^[+-]?0*([0-9]*)", 1))
        return F.when(self.digits.contains("E"), F.abs(self.double) >= float(10 ** places)).otherwise(
            digits > places)

    def finer_than(self, scale: int) -> Column:
        """More decimal places than ``scale``, trailing zeros aside.

        The shortest notation has no trailing zeros but ``.0``, so places are read off the
        text; only exponents go through a wide decimal.
        """
        if self.decimal is not None:
            return F.round(self.decimal, scale) != self.decimal
        fraction = F.substring_index(self.digits, ".", -1)
        plain = (F.instr(self.digits, ".") > 0) & (fraction != "0") & (
            F.length(fraction) > scale)
        wide = self.digits.try_cast(_WIDE)
        exact = (F.round(wide, scale) != wide) | ((wide == 0) & (self.double != 0))
        return F.when(self.digits.contains("E"), F.coalesce(exact, F.lit(False))).otherwise(plain)


def _cell(field: T.StructField, from_text: bool = False) -> _Cell:
    value, dtype = F.col(f"`{field.name}`"), field.dataType
    none = F.lit(None)
    if isinstance(dtype, T.VariantType):
        return _variant_cell(value)
    if isinstance(dtype, T.StringType) and from_text:
        return _text_cell(value)
    if isinstance(dtype, T.StringType):
        return _Cell(F.when(value.isNotNull(), "str"), value, none.cast("string"),
                     none.cast("double"))
    kind = "bool"
    if isinstance(dtype, T.IntegralType):
        kind = "int"
    elif isinstance(dtype, (T.FractionalType, T.DecimalType)):
        kind = "float"
    elif isinstance(dtype, T.DateType):
        kind = "date"
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        kind = "datetime"
    numeric = kind in ("int", "float")
    return _Cell(
        F.when(value.isNotNull(), kind), none.cast("string"),
        value.cast("string") if numeric else none.cast("string"),
        value.cast("double") if numeric else none.cast("double"),
        value if isinstance(dtype, T.DecimalType) else None)


def _text_cell(value: Column) -> _Cell:
    """A cell of a text file: its kind is read off the text."""
    day = value.rlike(_ISO_DATE) & value.try_cast("timestamp_ntz").isNotNull()
    moment = value.rlike(_ISO_MOMENT) & value.try_cast("timestamp_ntz").isNotNull()
    kind = (
        F.when(value.isNull() | (value == ""), F.lit(None))
        .when(value.rlike(_INTEGER), "int").when(value.rlike(_NUMBER), "float")
        .when(moment, "datetime").when(day, "date")
        .when(F.lower(value).isin("true", "false"), "bool").otherwise("str"))
    digits = F.when(value.rlike(_NUMBER), F.regexp_replace(
        F.regexp_replace(F.upper(value), "([.][0-9]*?)0+(?=$|E)", "$1"), "[.](?=$|E)", ".0"))
    return _Cell(kind, value, digits, digits.try_cast("double"))


def _variant_cell(value: Column) -> _Cell:
    """JSON has no dates: ISO text is how a date or a time is written there."""
    token = F.schema_of_variant(value)
    text = F.when(token == "STRING", F.try_variant_get(value, "$", "string"))
    number = token.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    as_text = F.when(number, F.try_variant_get(value, "$", "string"))
    moment = text.rlike(_ISO_MOMENT) & text.try_cast("timestamp_ntz").isNotNull()
    day = text.rlike(_ISO_DATE) & text.try_cast("timestamp_ntz").isNotNull()
    kind = (
        F.when(token.isNull() | (token == "VOID"), F.lit(None))
        .when(moment, "datetime").when(day, "date").when(token == "STRING", "str")
        .when(token == "BIGINT", "int").when(number, "float").when(token == "BOOLEAN", "bool")
        .otherwise(token))
    return _Cell(kind, text, as_text, as_text.try_cast("double"))


def _settled(declared: str, dtype: T.DataType) -> set[str]:
    """Codes that a column's type already rules out."""
    match = re.match(DECIMAL_TYPE, declared)
    if declared == "integer" and isinstance(dtype, T.IntegralType):
        return {"INVALID_INTEGER"}
    if declared == "text" and isinstance(dtype, T.StringType):
        return {"INVALID_TEXT"}
    if declared in ("date", "datetime") and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return {"INVALID_DATE", "INVALID_DATETIME"}
    if declared == "date" and isinstance(dtype, T.DateType):
        return {"INVALID_DATE"}
    if match and isinstance(dtype, T.DecimalType):
        precision, scale = int(match.group(1)), int(match.group(2))
        return {"INVALID_DECIMAL"} | (
            {"DECIMAL_SCALE_EXCEEDED"} if dtype.scale <= scale else set()) | (
            {"DECIMAL_PRECISION_EXCEEDED"} if dtype.precision - dtype.scale <= precision - scale else set())
    if match and isinstance(dtype, T.IntegralType):
        return {"INVALID_DECIMAL", "DECIMAL_SCALE_EXCEEDED"}
    return set()


def _problems(entry: ContractColumn, cell: _Cell, holds_text: bool,
              text_kinds: tuple[str, ...]) -> list[tuple]:
    """(level, code, condition, message) of one contract column."""
    stripped = F.btrim(cell.text, F.lit(_SPACES))
    blank = cell.kind.isNull()
    if holds_text:
        blank = blank | F.coalesce(stripped == "", F.lit(False))
    filled = ~blank
    checks = []
    if holds_text:      # a typed number or date cannot be a formula or padded
        checks += [
            ("ERROR", "FORMULA_NOT_ALLOWED", filled & cell.text.startswith("=")),
            ("WARNING", "TEXT_SURROUNDING_WHITESPACE", filled & (stripped != cell.text)),
        ]
    if entry.required:
        checks.insert(0, ("ERROR", "REQUIRED_VALUE_MISSING", blank))
    finite = ~(F.isnan(cell.double) | (F.abs(cell.double) == float("inf")))
    number = cell.kind.isin("int", "float") & F.coalesce(finite, F.lit(False))
    out = [(level, code, condition, F.lit(MESSAGES[code])) for level, code, condition in checks]

    def wrong(code: str, condition: Column):
        out.append(("ERROR", code, filled & condition,
                    F.concat(F.lit(MESSAGES[code]), cell.kind)))

    match = re.match(DECIMAL_TYPE, entry.declared)
    if entry.declared == "text":
        wrong("INVALID_TEXT", ~cell.kind.isin(*(text_kinds or ("str",))))
    elif entry.declared == "integer":
        wrong("INVALID_INTEGER", ~((cell.kind == "int") | (number & F.coalesce(cell.whole(), F.lit(False)))))
    elif match:
        precision, scale = int(match.group(1)), int(match.group(2))
        wrong("INVALID_DECIMAL", ~number)
        for code, condition in (
                ("DECIMAL_SCALE_EXCEEDED", cell.finer_than(scale)),
                ("DECIMAL_PRECISION_EXCEEDED", cell.beyond(precision - scale))):
            text = MESSAGES[code].format(precision=precision, scale=scale)
            out.append(("ERROR", code, filled & number & condition, F.lit(text)))
    elif entry.declared == "date":
        wrong("INVALID_DATE", ~cell.kind.isin("date", "datetime"))
    elif entry.declared == "datetime":
        wrong("INVALID_DATETIME", cell.kind != "datetime")
    else:
        out.append(("ERROR", "UNKNOWN_CONTRACT_TYPE", filled,
                    F.lit(MESSAGES["UNKNOWN_CONTRACT_TYPE"] + entry.declared)))
    return out


def value_issues(sheet: DataFrame, name: str, contract: list[ContractColumn],
                 row: str = "source_row_number", from_text: bool = False) -> DataFrame:
    """(level, code, sheet, row, column, message) of every offending cell.

    Columns may be typed, or VARIANT where a column mixes types.  ``from_text``: the text columns
    are cells of a text file, whose kind is read off the text (anything is a text there).
    """
    fields = {f.name: f for f in sheet.schema.fields}
    found = []
    for entry in contract:
        if entry.sheet != name:
            continue
        field = fields[entry.column]
        from_json = isinstance(field.dataType, T.VariantType)
        holds_text = from_json or isinstance(field.dataType, T.StringType)
        as_text = isinstance(field.dataType, T.StringType) and from_text
        texts = ("str", "int", "float", "bool", "date", "datetime") if as_text else (
            ("str", "date", "datetime") if from_json else ())
        settled = set() if as_text else _settled(entry.declared, field.dataType)
        for level, code, condition, message in _problems(
                entry, _cell(field, from_text), holds_text, texts):
            if code in settled:
                continue
            found.append((condition, F.struct(
                F.lit(level).alias("level"), F.lit(code).alias("code"),
                F.lit(name).alias("sheet"), F.col(row).alias("source_row_number"),
                F.lit(entry.column).alias("column"), message.alias("message"))))
    if not found:
        found = [(F.lit(False), F.struct(
            *[F.lit(None).cast("string").alias(c) for c in ("level", "code", "sheet")],
            F.col(row).alias("source_row_number"),
            *[F.lit(None).cast("string").alias(c) for c in ("column", "message")]))]
    return explode_where(sheet, found)


def variant_sheet(raw: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """Raw JSON rows of one sheet as VARIANT columns."""
    parsed = raw.where(F.col("sheet") == sheet).select(
        "source_row_number", F.parse_json("source_data").alias("_row"))
    return parsed.select("source_row_number", *[
        F.try_variant_get("_row", f"$.{c}", "variant").alias(c) for c in columns])


# --- C14, C15: roll-ups ---------------------------------------------------------------------------

def _counts(issues: DataFrame, once: Column | None) -> DataFrame:
    once = F.lit(None).cast("string") if once is None else once
    return issues.groupBy("level", "code", once.alias("_once")).agg(F.count("*").alias("_n"))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("level", "code").agg(
        F.sum(F.when(F.col("_once").isNull(), F.col("_n")).otherwise(1)).alias("issue_count"))


def counted_issues(issues: DataFrame, once: Column | None = None) -> DataFrame:
    """Issues per (level, code); those with the same value of ``once`` (where it is not null) count as one."""
    return _totals(_counts(issues, once))


def _first(issues: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first issues of a (level, code) with their ``_rank``.

    The row number is filtered by a constant, which Spark applies per task before the exchange:
    a code that fires on every row still sends only ``limit`` examples per task.
    """
    first = Window.partitionBy("level", "code").orderBy(*order)
    return issues.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= limit)


def _listed(first: DataFrame, example: Column) -> DataFrame:
    return (
        first.withColumn("_example", example).groupBy("level", "code")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "_example"))).alias("e"))
        .select("level", "code", F.col("e._example").alias("examples"))
    )


def issue_rollup(issues: DataFrame, order: list[str], example: Column,
                 limit: int = VALUE_EXAMPLES, once: Column | None = None) -> DataFrame:
    """C14: number of issues per (level, code) with the first ``limit`` examples.

    ``once``: see ``counted_issues``.
    """
    return counted_issues(issues, once).join(_listed(_first(issues, order, limit), example), ["level", "code"])


def stored_rollup(parts: list[DataFrame], order: list[str], example: Column, store: Callable[[DataFrame, str], DataFrame],
                  limit: int = VALUE_EXAMPLES, once: Column | None = None) -> DataFrame:
    """``issue_rollup`` of all ``parts`` together, of which one at a time is worked on and on disk.

    Of a part its counts and the first ``limit`` issues of each (level, code) are stored: the first of all are among these.
    """
    kept = []
    for i, issues in enumerate(parts):
        issue = F.struct(*issues.columns)
        counts, first = _counts(issues, once), _first(issues, order, limit).select("level", "code", issue.alias("_issue"))
        kept.append(store(counts.unionByName(first, allowMissingColumns=True), f"issues-{i}"))
    rows = reduce(DataFrame.unionByName, kept)
    counts = rows.where("_issue is null").groupBy("level", "code", "_once").agg(F.sum("_n").alias("_n"))
    first = rows.where("_issue is not null").select("_issue.*")
    return _totals(counts).join(_listed(_first(first, order, limit), example), ["level", "code"])


def value_totals(rows: dict[str, DataFrame], contract: list[ContractColumn],
                 issues: DataFrame) -> DataFrame:
    """Rows, values checked, errors, warnings and the verdict; one row."""
    counts = None
    for name, df in rows.items():
        width = sum(1 for c in contract if c.sheet == name)
        counted = df.agg(F.count("*").alias("n"), (F.count("*") * width).alias("v"))
        counts = counted if counts is None else counts.union(counted)
    levels = issues.agg(F.struct(
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings")))
    return counts.agg(
        F.sum("n").alias("total_rows"), F.sum("v").alias("values_checked"),
    ).select("*", levels.scalar().alias("levels")).select(
        "total_rows", "values_checked", F.col("levels.errors").alias("error_count"),
        F.col("levels.warnings").alias("warning_count"),
    ).withColumn("valid", F.col("error_count") == 0)
