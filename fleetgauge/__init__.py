"""Fleet-wide analytics over equipment telemetry, written as Spark DataFrame jobs.

Every operator is a function ``f(df, ...) -> DataFrame`` keyed by
``(site, device_id)``: one lazy job serves one machine or a hundred thousand.
"""

KEYS = ("site", "device_id")
