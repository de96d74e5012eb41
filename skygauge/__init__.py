"""skygauge: Spark DataFrame operators for weather and sensor event streams.

Every operator takes DataFrames or Columns and returns DataFrames or Columns, so
the same code serves batch jobs, SQL views and Structured Streaming queries.
"""
