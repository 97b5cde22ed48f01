"""runlens: run-telemetry analytics and corpus preparation as Spark DataFrame operators."""
