"""scopekit: Spark-native jobs for long-document emission-report extraction datasets.

Sub-packages
  sources    readers and sinks (Parquet, JSON, text, binary files)
  functions  column expressions (relevance, markup, paths, records, accuracy)
  operators  DataFrame -> DataFrame transformations (pages, prompts, outputs,
             evaluation, training sets, manifest, batch scoring)
  plans      derived test tables and the named-query catalog
  streaming  incremental collection of model outputs
"""

__all__ = ["session"]
