"""Baseline and panel files of experiments as the tables that the experiment operators take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import dates
from searchloom.operators.compare import issue_list
from searchloom.sources import exports

# Date layouts of experiment files.
DATE_FORMATS = ("yyyy-MM-dd",)


def plain_headers(headers: Sequence[str], required: Sequence[str], optional: Sequence[str]) -> dict[str, str]:
    """Header -> name by the exact text; a repeated or missing one raises, further columns are not read."""
    bare = [h.strip().lstrip("\ufeff") for h in headers]
    if len(set(bare)) != len(bare):
        raise ValueError("repeated column name")
    missing = [name for name in required if name not in bare]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return {h: f"c_{name}" for h, name in zip(headers, bare) if name in (*required, *optional)}


def _text(rows: DataFrame, name: str) -> Column:
    """Trimmed text of a column; NULL only where the file has no such column."""
    column = f"c_{name}"
    return F.coalesce(F.trim(column), F.lit("")) if column in rows.columns else F.lit(None).cast("string")


def _number(text: Column) -> Column:
    value = F.regexp_replace(text, ",", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _experiment(pattern: str | None) -> Column:
    return F.lit(None).cast("string") if pattern is None else F.regexp_extract("file", pattern, 1)


def read_baseline_csv(
    spark: SparkSession, path: str, metrics: Sequence[str], unit_column: str = "unit_id", matched: bool = False, experiment_from_path: str | None = None
) -> DataFrame:
    """Unit-days, or one row per unit where a file has no ``date`` column (``dated`` tells), as ``baseline_units`` takes them.

    ``experiment_from_path`` is a pattern whose first group names the experiment. ``pair_id`` is required where the design is ``matched``. A row's
    ``issues``: a blank unit, an unreadable day or number, a blank pair.
    """
    required = [unit_column, *metrics, *(["pair_id"] if matched else [])]
    rows = exports.read_mapped_csv(spark, path, lambda names: plain_headers(names, required, ("date", "pair_id")))
    unit, pair, date = _text(rows, unit_column), _text(rows, "pair_id"), F.col("c_date") if "c_date" in rows.columns else F.lit(None).cast("string")
    # a file without the column gives NULL; in a file with it a blank cell is read as NULL too, so the header decides
    dated = F.lit("c_date" in rows.columns)
    day = dates.parse_date(date, DATE_FORMATS)
    return rows.select(
        _experiment(experiment_from_path).alias("experiment_id"), unit.alias("unit_id"), F.when(pair != "", pair).alias("pair_id"), day.alias("day"),
        dated.alias("dated"), *[_number(F.col(f"c_{m}")).alias(m) for m in metrics],
        issue_list(
            F.col("row_issue"), F.when(unit == "", F.lit("missing_unit_id")), F.when(dated & day.isNull(), F.lit("invalid_date")),
            *[F.when(_number(F.col(f"c_{m}")).isNull(), F.lit(f"missing_or_invalid_metric:{m}")) for m in metrics],
            *([F.when(pair == "", F.lit("missing_pair_id"))] if matched else []),
        ).alias("issues"),
        "file", "at",
    )


def read_panel_csv(
    spark: SparkSession, path: str, metrics: Sequence[str], unit_column: str = "unit_id", experiment_from_path: str | None = None, row_column: str | None = None
) -> DataFrame:
    """Unit-days with texts as ``typed_panel`` takes them; a flag is NULL where the file has no such column and blank where the cell is.

    ``row_id`` orders the rows: the file and the place in it, or the number in ``row_column``.
    """
    required = [unit_column, "date", "group", *metrics]
    optional = ["contaminated", "treatment_applied", *([row_column] if row_column else [])]
    rows = exports.read_mapped_csv(spark, path, lambda names: plain_headers(names, required, optional))
    row_id = F.col(f"c_{row_column}").try_cast("bigint") if row_column else F.concat("file", F.lit(":"), F.lpad(F.col("at").cast("string"), 19, "0"))
    return rows.select(
        row_id.alias("row_id"), _experiment(experiment_from_path).alias("experiment_id"), F.coalesce(f"c_{unit_column}", F.lit("")).alias("unit_id"),
        dates.parse_date(F.col("c_date"), DATE_FORMATS).alias("day"), F.coalesce("c_group", F.lit("")).alias("group_text"),
        *[F.coalesce(f"c_{m}", F.lit("")).alias(m) for m in metrics],
        _text(rows, "contaminated").alias("contaminated_text"), _text(rows, "treatment_applied").alias("applied_text"), "row_issue",
    )


def contamination_observable(panel: DataFrame) -> bool:
    """Whether a panel file tells who was treated; without it adherence cannot be checked."""
    return not panel.where(F.col("applied_text").isNotNull()).isEmpty()
