"""Commuter flows from indicator records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["geocod", "genero", "ocupacao", "destino"]


def dados_of(year: str, column: str = "Dados") -> Column:
    """The records of one year of an indicator; null if the year is missing."""
    return F.element_at(F.col(column), F.lit(year))


def records_of(indicator: DataFrame, year: str) -> DataFrame:
    """One row for each record of the year."""
    return indicator.select(F.explode(dados_of(year)).alias("r")).select("r.*")


def select_areas(records: DataFrame, names: list[str]) -> DataFrame:
    """Records whose area name is in the list."""
    return records.where(F.col("geodsg").isin(names))


def area_codes(records: DataFrame) -> DataFrame:
    """Distinct (geocod, geodsg)."""
    return records.select("geocod", "geodsg").distinct()


def movements_for_areas(movements: DataFrame, areas: DataFrame) -> DataFrame:
    """Movement records of the areas' codes."""
    return movements.join(areas.select("geocod").distinct(), "geocod", "left_semi")


def filter_movements(movements: DataFrame, total: str = "T", needle: str = "freguesia") -> DataFrame:
    """Total rows of the fifth axis whose destination holds ``needle``, in that case."""
    return movements.where((F.col("dim_5") == total) & F.col("dim_6_t").contains(needle))


def to_flow_schema(movements: DataFrame, keep_code: bool = True) -> DataFrame:
    """The flow table's columns. Codes stay by default, since several areas can have one name."""
    columns = [F.col("geodsg").alias("freguesia"), F.col("dim_3_t").alias("genero"), F.col("dim_4_t").alias("ocupacao"), F.col("dim_6_t").alias("destino"), F.col("valor").try_cast("long").alias("valor")]
    return movements.select(*([F.col("geocod")] if keep_code else []), *columns)


def union_areas(parts: list[DataFrame]) -> DataFrame:
    """All areas' records, repeated ones kept."""
    return reduce(DataFrame.unionByName, parts)


def homonyms(records: DataFrame) -> DataFrame:
    """(geodsg, n_codes) of names that several codes share."""
    return records.select("geodsg", "geocod").distinct().groupBy("geodsg").agg(F.count("geocod").alias("n_codes")).where("n_codes > 1")


def flow_totals(flows: DataFrame, sex_total: str = "HM", job_total: str = "Total") -> DataFrame:
    """Totals over sex and occupation of leaf rows: published total rows are left out, then made anew by ``cube``."""
    leaves = flows.where((F.col("genero") != sex_total) & (F.col("ocupacao") != job_total))
    # zone and destination are in every grouping: the cube is over two columns only
    cubed = leaves.groupingSets([["geocod", "destino", "genero", "ocupacao"], ["geocod", "destino", "genero"], ["geocod", "destino", "ocupacao"], ["geocod", "destino"]], "geocod", "destino", "genero", "ocupacao").agg(F.sum("valor").alias("valor"), F.grouping("genero").alias("_g"), F.grouping("ocupacao").alias("_o"))
    return cubed.select("geocod", F.when(F.col("_g") == 1, sex_total).otherwise(F.col("genero")).alias("genero"), F.when(F.col("_o") == 1, job_total).otherwise(F.col("ocupacao")).alias("ocupacao"), "destino", "valor")


def reconcile_totals(flows: DataFrame, sex_total: str = "HM", job_total: str = "Total") -> DataFrame:
    """Rows in which published and computed values differ: keys, published, computed."""
    computed = flow_totals(flows, sex_total, job_total).withColumnRenamed("valor", "computed")
    published = flows.groupBy(*KEYS).agg(F.sum("valor").alias("published"))
    both = published.join(computed, KEYS, "full")
    return both.where(~F.col("published").eqNullSafe(F.col("computed")))
