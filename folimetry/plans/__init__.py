"""Query plans registered for the driver, with their reference SQL."""

from folimetry.plans import aggregation, gathered, geometry, ingest, layouts, metrics, parsing, pictures, reshaping, results, text  # noqa: F401
