"""threadlens: discussion-forum engagement analytics as Spark DataFrame jobs.

Layout
------
sources/    table roles (posts, comments, interactions), JSON lists, ingest, sinks
functions/  column expressions: predicates, time buckets, text, sentiment
operators/  DataFrame operators: engagement, time series, graph, Louvain, ML, text
plans/      end-to-end jobs (the reference dashboards' flows) and the query catalog
streaming/  Structured Streaming forms of ingest, windows and alert state
"""

__version__ = "0.1.0"
