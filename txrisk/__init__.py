"""txrisk: transaction-risk analytics on Spark.

Subpackages
-----------
sources    readers and writers (driver tables, CSV ingest, JSON/CSV artefacts, model store, prediction log)
functions  column expressions (risk bands, hashed randomness, explanation text)
operators  DataFrame operators (cleaning, statistics, features, ordering/scans, EDA, metrics, sampling, kNN, explanation)
plans      multi-step jobs (model training, scoring, the end-to-end training job)
streaming  Structured Streaming scorer and running totals
"""

__version__ = "0.1.0"
