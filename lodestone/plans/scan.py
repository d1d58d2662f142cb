"""The scan: versions to findings, coverage and status, as one declarative plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relate
from ..operators.detect import candidates, first_versions, introduced, located, rules_table


def scan(versions: DataFrame, exceptions: DataFrame | None = None, ips: DataFrame | None = None, hosts: DataFrame | None = None, groups: list[str] = (), local: bool = False, places: bool = True, history: bool = False) -> DataFrame:
    """Findings of each (path, object) once, at the commit that introduces it, less what exceptions and allowlists suppress.

    Texts aren't shuffled: detectors read each version where it is stored, and repeated findings meet as narrow rows.
    Where most versions repeat an object (history), the introducing versions are chosen first. Without places, lines
    and columns aren't found.
    """
    chosen = first_versions(versions) if history else versions
    found = introduced(candidates(chosen, groups=groups, places=places, context=local).drop("text"))
    if exceptions is not None:
        found, _ = relate.split_exempt(found, exceptions)
    if ips is not None:
        found = relate.without_allowed_ips(found, ips)
    if hosts is not None:
        found = relate.without_allowed_hosts(found, hosts)
    out = relate.with_topics(located(found, local), rules_table(versions.sparkSession))
    return out.withColumn("severity", F.lit("warning")).withColumn("judgment", F.lit("unreviewed"))
