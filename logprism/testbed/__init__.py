"""Log tables derived from the driver's parquet tables.

The scalar rules are SQL text that means the same in Spark and in other ANSI
engines, so the result check can state them once (``logprism.testbed.rules``).
"""
