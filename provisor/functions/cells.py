"""Export cells, hashes, JSON values and typed casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# First characters a spreadsheet would read as a formula; columns with a type.
FORMULA_START = r"^[\s\x1c-\x1f\x85]*[=+\-@]|^[\t\r\n]"
DATE_COLUMNS = ("version_date", "effective_from", "effective_to", "last_production_date", "transition_end")
TIME_COLUMNS = ("fetched_at",)
DECIMAL_COLUMNS = {"confidence": "decimal(3,2)"}


def export_cell(column: Column, data_type: T.DataType | None = None) -> Column:
    """Text of one flat-file cell: null is empty, nested is JSON, formulas get an apostrophe."""
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    guarded = text
    if data_type is None or isinstance(data_type, (T.StringType, T.StructType, T.ArrayType, T.MapType)):
        guarded = F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)
    return F.coalesce(guarded, F.lit(""))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def json_merge(left: Column, right: Column) -> Column:
    """Union of two maps; the right side wins on equal keys."""
    keep = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(keep, right)


def to_typed(name: str, text: Column) -> Column:
    """ISO text to the stored type of a catalog column, by column name."""
    if name in DATE_COLUMNS:
        return F.to_date(text, "yyyy-MM-dd")
    if name in TIME_COLUMNS:
        return F.to_timestamp(text)
    if name in DECIMAL_COLUMNS:
        return text.cast(DECIMAL_COLUMNS[name])
    return text


def web_url(value: Column) -> Column:
    """The value itself when it is an absolute http(s) address, else null."""
    scheme = F.lower(F.try_parse_url(value, F.lit("PROTOCOL")))
    return F.when(scheme.isin("http", "https"), value)


def documented_code(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\bTR_TS_(\d{3})_(\d{4})\b", "ТР ТС $1/$2")


def is_host_of(url: Column, hosts: list[str]) -> Column:
    """True when the address lies on one of the hosts or below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    hit = F.lit(False)
    for name in hosts:
        hit = hit | (host == name) | host.endswith("." + name)
    return F.coalesce(hit, F.lit(False))
