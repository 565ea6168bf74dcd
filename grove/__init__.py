"""grove: supervised learning on large tables, as Spark DataFrame and ML plans.

Read delimited or parquet tables, split rows by key, train random forests
(regression, binary, multiclass; fixed size or cross-validated grid),
evaluate them with distributed aggregates, refit, save, load and score.
"""

__version__ = "0.1.0"
