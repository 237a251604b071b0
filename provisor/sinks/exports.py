"""Flat sheets, nested JSON and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provisor.functions.cells import export_cell


def answer_rows(runs: DataFrame) -> DataFrame:
    """One row per run, method and code from the two answer maps."""
    parts = [
        runs.select("run_id", F.lit(method).alias("method"), F.explode(f"{method}_answers").alias("e_code", "answer"))
        for method in ("manual", "app")
    ]
    return parts[0].unionByName(parts[1])


def sheets(runs: DataFrame, attempts: DataFrame, photos: DataFrame, validations: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    """The six sheets of a study export."""
    return {
        "runs": runs.drop("manual_answers", "app_answers"), "answers": answer_rows(runs), "attempts": attempts,
        "photos": photos, "validations": validations, "audit": audit,
    }


def safe_cells(df: DataFrame) -> DataFrame:
    """All columns as text that a spreadsheet never runs as a formula."""
    return df.select(*[export_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    """CSV folder per sheet, header in every file; files are written in parallel."""
    for name, df in tables.items():
        safe_cells(df).write.mode("error").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("ignoreNullFields", False).json(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per report section."""
    for name, df in sections.items():
        write_json(df, f"{path}/{name}")


def blinded(details: DataFrame, reveal: bool = False) -> DataFrame:
    """Run details without results and answers unless revealed."""
    hidden = [] if reveal else [c for c in ("result", "manual_answers", "app_answers") if c in details.columns]
    return details.drop(*hidden)
