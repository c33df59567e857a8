"""Validation of input features by object type: one aggregation pass, a report row a finding.

Errors never stop a run; they only change the stage that is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import refdata as R


def _text(name: str) -> Column:
    return F.get_json_object("properties", f"$.{name}")


def rules() -> list[tuple[str, str, Column]]:
    """(level, code, condition) of every rule; a value that is no number is its own finding and no other."""
    kind, blank = F.col("object_type"), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    number = lambda name: _text(name).try_cast("double")
    out = [
        ("warning", "missing_id", blank(F.col("feature_id"))),
        ("error", "missing_type", blank(kind)),
        ("warning", "unknown_type", ~blank(kind) & ~kind.isin(*R.OBJECT_TYPES)),
    ]
    for owner, name in (("heat_network", "diameter"), ("oks_connection_point", "flow_tph")):
        own = kind == owner
        out += [
            ("error", f"{owner}_without_{name}", own & _text(name).isNull()),
            ("error", f"{owner}_{name}_not_a_number", own & _text(name).isNotNull() & number(name).isNull()),
            ("warning", f"{owner}_{name}_not_positive", own & (number(name) <= 0)),
        ]
    of = _text("restriction_type")
    out.append(("warning", "restriction_without_type", (kind == "restriction") & of.isNull()))
    out.append(("warning", "restriction_of_unknown_type", (kind == "restriction") & ~of.isin(*R.RESTRICTIONS)))
    return out


def validate(features: DataFrame) -> DataFrame:
    """(level, code, n): the total as an info row (an error if there are no features), and each rule with findings.

    ``features`` has feature_id, object_type and properties, a JSON object as text.
    """
    found = rules()
    counts = features.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(code) for _, code, c in found])
    rows = [F.struct(F.when(F.col("total") == 0, "error").otherwise("info").alias("level"), F.lit("total").alias("code"), F.col("total").alias("n"))]
    rows += [F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(code).alias("n")) for level, code, _ in found]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0 or code = 'total'")


def stage(report: DataFrame) -> str:
    """What the run reports: the stage changes with errors, the run goes on."""
    return "validated" if report.where("level = 'error'").isEmpty() else "validated_with_errors"
