"""Counts and grouped issues for reports, and the Markdown that shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrgraph.operators.graph import Graph

#: Above so many issues a report shows groups with so many examples.
LISTED, EXAMPLES = 30, 3


def issue_groups(found: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(severity, code, n, examples): examples are the first subjects, picked by rank, so lists stay short."""
    key = ["severity", "code"]
    counts = found.groupBy(*key).agg(F.count("*").alias("n"))
    named = found.select(*key, F.coalesce("subject_id", "message").alias("e"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("e"))).filter(F.col("r") <= examples)
    shown = first.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("e")), ", ").alias("examples"))
    return counts.join(shown, key)


def kind_counts(g: Graph) -> DataFrame:
    return g.entities.groupBy("kind").agg(F.count("*").alias("n"))


def relation_counts(g: Graph) -> DataFrame:
    return g.mappings.groupBy("relation").agg(F.count("*").alias("n"))


def _cell(text) -> str:
    return str(text if text is not None else "").replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], rows) -> list[str]:
    return ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |", *("| " + " | ".join(map(_cell, r)) + " |" for r in rows)]


def issue_table(found: DataFrame) -> list[str]:
    rows = found.orderBy("severity", "code", "subject_id").limit(LISTED + 1).collect()
    if not rows:
        return ["No issues."]
    if len(rows) > LISTED:
        groups = issue_groups(found).orderBy("severity", "code").collect()  # one row for each code
        return _table(["Severity", "Code", "Count", "Examples"], [(r.severity, r.code, r.n, r.examples) for r in groups])
    return _table(["Severity", "Code", "Subject", "Message"], [(r.severity, r.code, r.subject_id, r.message) for r in rows])


def drift_report(title: str, validation: DataFrame, drift: DataFrame, changes: DataFrame | None = None) -> str:
    lines = [f"# {title}", "", "## Validation", "", *issue_table(validation), "", "## Drift", "", *issue_table(drift)]
    if changes is not None:
        from corrgraph.operators.diff import counts

        lines += ["", "## Changes", "", *_table(["Change", "Count"], [(r.change, r.n) for r in counts(changes).orderBy("change").collect()])]
    return "\n".join(lines) + "\n"


def documentation(title: str, g: Graph) -> str:
    kinds = kind_counts(g).orderBy("kind").collect()  # one row for each kind
    relations = relation_counts(g).orderBy("relation").collect()
    modes = g.authorities.groupBy("mode").count().orderBy("mode").collect()
    return "\n".join([f"# {title}", "", "## Entities", "", *_table(["Kind", "Count"], kinds), "", "## Relations", "", *_table(["Relation", "Count"], relations), "", "## Authorities", "", *_table(["Mode", "Count"], modes)]) + "\n"
