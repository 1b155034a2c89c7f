"""pricewise: listing-price analytics as Spark DataFrame operators.

Sub-packages
------------
sources    readers, sinks and the derived test-data views
functions  column-expression helpers (variant coercion, seeded hashing,
           distributed ranking, exact quantiles, inverse normal)
operators  the pipeline stages: extraction cleaning, crawl ledger, split,
           features, training, evaluation, batch inference, scenarios
plans      end-to-end chains of operators and the registered test queries
streaming  Structured Streaming variants of scenario scoring and the ledger
"""

__version__ = "0.1.0"
