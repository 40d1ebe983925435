"""Per-session reuse of derived-table *plans*.

Building the survey-shaped frames takes thousands of JVM calls; a DataFrame is
an immutable logical plan, so queries of one session share the plan object
instead of rebuilding it. Nothing is cached in memory or on disk by this.
"""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession

def shared_plan(fn):
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args, **kwargs):
        plans = spark.__dict__.setdefault("_sondeo_plans", {})  # a plan belongs to its session, not to the application
        key = (fn.__module__, fn.__qualname__, sf_dir, args, tuple(sorted(kwargs.items())))
        if key not in plans:
            plans[key] = fn(spark, sf_dir, *args, **kwargs)
        return plans[key]

    return wrapper
