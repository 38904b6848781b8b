"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame

from fleetpulse.session import materialize, scratch_dir

__all__ = ["free_name", "importable", "materialize", "scratch_dir"]

ROOT = str(Path(__file__).resolve().parents[2])


def free_name(columns: list[str], name: str) -> str:
    """``name``, longer by underscores until no column has it (letter case aside, as Spark resolves names)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def importable(df: DataFrame) -> DataFrame:
    """Adds this package's folder to the module path of Python workers, for sessions that were started elsewhere.

    On a cluster whose machines don't share the folder, the package is shipped with ``--py-files`` as usual.
    """
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return df
