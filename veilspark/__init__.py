"""veilspark: de-identify Spark tables and measure what that costs.

Sub-packages
------------
functions   column expressions and distributed statistics (quantiles, ranks)
operators   de-identification techniques, risk measures, parameter searches
plans       whole studies: combinations, risk tables, model evaluation, tests
sources     dataset registry, variant and result tables, CSV/TSV
streaming   fitted policies on Structured Streaming
catalog     the registered queries and their SQL twins
"""

__version__ = "0.1.0"
