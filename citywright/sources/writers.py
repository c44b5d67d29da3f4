"""Writers. Existing output is an error unless ``mode`` says otherwise; inputs are never written over."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import s_to_hms


def write_flows(flows: DataFrame, path: str, mode: str = "error") -> None:
    """Flow table as CSV with a header, quoted where needed."""
    flows.write.mode(mode).option("header", True).csv(path)


def write_joint(joint: DataFrame, path: str, drop_zero: bool = False, as_csv: bool = False, mode: str = "error") -> None:
    """Joint distribution as Section, Var1..VarN, Value, zero cells included unless ``drop_zero``."""
    names = [c for c in joint.columns if c.startswith("d") and c[1:].isdigit()]
    section = [F.col("section").alias("Section")] if "section" in joint.columns else []
    rows = joint.where("value != 0") if drop_zero else joint
    out = rows.select(*section, *[F.col(c).alias(f"Var{c[1:]}") for c in names], F.col("value").alias("Value")).write.mode(mode)
    out.option("header", True).csv(path) if as_csv else out.parquet(path)


def write_plans(plan_elements: DataFrame, path: str, mode: str = "error") -> None:
    """Plan elements as Parquet, by iteration."""
    plan_elements.write.mode(mode).partitionBy("iteration").parquet(path)


def write_network(nodes: DataFrame, links: DataFrame, path: str, mode: str = "error") -> None:
    """Nodes and links as two Parquet tables."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    links.write.mode(mode).parquet(f"{path}/links")


def _attributes(**values: Column) -> Column:
    """XML attributes of the values that are not null, each with a space in front."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(*[F.coalesce(F.concat(F.lit(f' {name}="'), escaped(c), F.lit('"')), F.lit("")) for name, c in values.items()])


def _write_framed(lines: DataFrame, path: str, frame: Callable[[Iterator[dict]], Iterator[str]], mode: str) -> None:
    """Each partition as one text file of what ``frame`` makes of its rows; files appear when their tasks are committed, and an aborted one leaves none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[str] = []
        for line in frame(row for batch in batches for row in batch.to_pylist()):
            part.append(line)
            if len(part) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(part)], names=["value"])
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(part)], names=["value"])

    lines.mapInArrow(run, "value string").write.mode(mode).text(path)


def write_plans_xml(plan_elements: DataFrame, path: str, mode: str = "error") -> None:
    """Plan elements as XML population files: persons with their plans, and in a plan activities and legs by ``pos``.

    Columns as ``read_plans`` gives them; of one iteration. Persons are dealt to files by their id and sorted in each, and a person's rows pass one by one.
    A person, plan or element with a null id stays as it is, null values are left out, and a leg's end is its departure plus its travel time.
    """
    hms = lambda c: s_to_hms(F.col(c))
    act = F.concat(F.lit("<activity"), _attributes(type=F.col("type"), link=F.col("link"), x=F.col("x"), y=F.col("y"), start_time=hms("start_s"), end_time=hms("end_s"), max_dur=hms("max_dur_s")), F.lit("/>"))
    routing = F.coalesce(F.concat(F.lit("<attributes><attribute"), _attributes(name=F.when(F.col("routing_mode").isNotNull(), F.lit("routingMode"))), F.lit(' class="java.lang.String">'), F.replace(F.replace("routing_mode", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</attribute></attributes>")), F.lit(""))
    leg = F.concat(F.lit("<leg"), _attributes(mode=F.col("mode"), dep_time=hms("start_s"), trav_time=s_to_hms(F.col("end_s") - F.col("start_s"))), F.lit(">"), routing, F.lit("</leg>"))
    plan = _attributes(selected=F.when(F.col("selected"), "yes").otherwise("no"), score=F.col("score"))
    rows = plan_elements.select("person_id", "plan_idx", "pos", _attributes(id=F.col("person_id")).alias("person"), plan.alias("plan"), F.when(F.col("kind") == "leg", leg).otherwise(act).alias("element"))
    ordered = rows.repartition("person_id").sortWithinPartitions("person_id", "plan_idx", "pos").select("person", "plan_idx", "plan", "element")

    def frame(rows: Iterator[dict]) -> Iterator[str]:
        begun = False
        for person, own in groupby(rows, key=lambda r: r["person"]):
            if not begun:
                yield '<?xml version="1.0" encoding="utf-8"?>'
                yield "<population>"
                begun = True
            yield f"<person{person}>"
            for (_, plan), elements in groupby(own, key=lambda r: (r["plan_idx"], r["plan"])):
                yield f"<plan{plan}>"
                for e in elements:
                    yield e["element"]
                yield "</plan>"
            yield "</person>"
        if begun:
            yield "</population>"

    _write_framed(ordered, path, frame, mode)


def write_network_xml(nodes: DataFrame, links: DataFrame, path: str, mode: str = "error") -> None:
    """Nodes (node_id, x, y) and links (link_id, from_node, to_node, length) as XML network files, in a folder each."""

    def framed(what: str) -> Callable[[Iterator[dict]], Iterator[str]]:
        def frame(rows: Iterator[dict]) -> Iterator[str]:
            begun = False
            for row in rows:
                if not begun:
                    yield '<?xml version="1.0" encoding="utf-8"?>'
                    yield f"<network><{what}>"
                    begun = True
                yield row["line"]
            if begun:
                yield f"</{what}></network>"

        return frame

    node = F.concat(F.lit("<node"), _attributes(id=F.col("node_id"), x=F.col("x"), y=F.col("y")), F.lit("/>"))
    link = F.concat(F.lit("<link"), _attributes(id=F.col("link_id"), **{"from": F.col("from_node"), "to": F.col("to_node")}, length=F.col("length")), F.lit("/>"))
    _write_framed(nodes.select(node.alias("line")), f"{path}/nodes", framed("nodes"), mode)
    _write_framed(links.select(link.alias("line")), f"{path}/links", framed("links"), mode)
