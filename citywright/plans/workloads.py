"""Whole workloads, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import flows as f
from ..operators.geo import check_boundaries
from ..operators.ipf import Spec, check_totals, ipf
from ..operators.network import clean_network
from ..operators.trips import activities, legs_from_elements, trips_from_legs


def joint_distribution(census: DataFrame, spec: Spec, section: str | None = None, **options) -> DataFrame:
    """Census to joint distribution; rejects dimensions whose totals differ over the whole table, as a check before fitting."""
    totals = check_totals(census, spec).first()
    if not totals["equal"]:
        raise ValueError(f"the dimensions' totals differ: {totals.asDict()}")
    return ipf(census, spec, section, **options)


def checked_plans(plan_elements: DataFrame, nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Activities (still in degrees) against the network's extent, and the cleaned network."""
    return check_boundaries(activities(plan_elements), nodes), *clean_network(nodes, links)


def legs_and_trips(plan_elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legs and trips of executed plans; both share one shuffle by plan."""
    legs = legs_from_elements(plan_elements)
    return legs, trips_from_legs(legs)


def collected_flows(records: DataFrame, names: list[str]) -> DataFrame:
    """Flow table of the named areas from indicator records."""
    chosen = f.area_codes(f.select_areas(records, names))
    return f.to_flow_schema(f.filter_movements(f.movements_for_areas(records, chosen)))
