"""tracewell: trajectory and telemetry analytics as Spark DataFrame operators and streams."""

__version__ = "0.1.0"
