"""Three-way manifest drift between a template, its stored snapshot and a project.

Inputs are (path, sha256) tables. States are mutually exclusive:

* ``new``        - in the template, not in the project
* ``removed``    - in the stored snapshot, no longer in the template
* ``unchanged``  - project == stored == template
* ``updated``    - project == stored, template moved on (safe to copy)
* ``local_edit`` - project != stored, template == stored (keep the edit)
* ``conflict``   - project != stored and template != stored

Two full outer joins on path; all three inputs are hash-partitioned on path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(template: DataFrame, stored: DataFrame, project: DataFrame) -> DataFrame:
    t = template.select(F.col("path"), F.col("sha256").alias("h_template"))
    s = stored.select(F.col("path"), F.col("sha256").alias("h_stored"))
    p = project.select(F.col("path"), F.col("sha256").alias("h_project"))
    j = t.join(s, "path", "full_outer").join(p, "path", "full_outer")
    in_t, in_s, in_p = F.col("h_template").isNotNull(), F.col("h_stored").isNotNull(), F.col("h_project").isNotNull()
    same_ps = in_p & in_s & (F.col("h_project") == F.col("h_stored"))
    same_ts = in_t & in_s & (F.col("h_template") == F.col("h_stored"))
    state = (
        F.when(in_t & ~in_p, "new")
        .when(~in_t & in_s, "removed")
        .when(in_t & same_ps & same_ts, "unchanged")
        .when(in_t & same_ps, "updated")
        .when(in_t & same_ts, "local_edit")
        .when(in_t, "conflict")
    )
    return j.select("path", state.alias("state")).where(F.col("state").isNotNull())
