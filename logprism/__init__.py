"""Log sampling, profiling and triage as Spark DataFrame operators."""
