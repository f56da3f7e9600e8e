"""shardloom: analytics over key-sharded time-series tables on Spark.

operators  DataFrame operators (scans, joins, aggregates, time series)
sources    line protocol, tick files, object notifications, checkpoints
functions  tolerant casts and scalar expressions
plans      dialect rewriting, routing, shard ring, the SQL engine
streaming  topics, live bars, replay, sinks
"""

__version__ = "0.1.0"
