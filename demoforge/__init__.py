"""demoforge: few-shot prompt data preparation and evaluation as Spark jobs.

Samples are rows ``(idx, input, label, category)``; every operator takes and
returns DataFrames and leaves the physical plan to Catalyst.  The language
model is a pluggable column function (see ``operators.predict``).
"""

__all__ = ["session", "sources", "functions", "operators", "plans"]
