"""wordtally: two-class bag-of-words document classification on Spark.

Layers:
  functions/  Column -> Column expressions (tokenizer, HTML text, cell typing, hashing)
  sources/    readers and writers (driver tables, manifests, files, reports)
  operators/  DataFrame operators (registry, dictionary, vectors, learners, evaluation, predict)
  plans/      named queries over the driver tables and their DuckDB oracle SQL
  streaming/  incremental import of newly arrived manifests
"""

__all__ = ["session", "options"]
