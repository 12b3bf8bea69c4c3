"""civitas — public-accountability analytics as Spark DataFrame / SQL jobs.

Subpackages
-----------
functions   Column expressions (cleaning, parsing, keys, labels); no Python UDFs.
sources     Readers and writers: Parquet, CSV, JSON, seeds, load statistics.
operators   DataFrame -> DataFrame building blocks: dedup, linking, aggregates,
            top-k, quantiles, outliers, scorecards, upserts, data quality.
streaming   Structured Streaming forms of the incremental jobs.
plans       The registered queries over the test tables plus their SQL oracles.
"""

__version__ = "0.1.0"
