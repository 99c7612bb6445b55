"""cohort: outcome analytics on Spark.

Modules: ``sources`` (tables, IO, contracts), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame operators and ML stages), ``plans`` (registered
queries and the flagship plan), ``streaming`` (foreachBatch monitor). ``session`` holds
the session helpers and the shared checkpoint folder; ``config`` the quantile mode and
window chunk counts.
"""

__version__ = "0.1.0"
