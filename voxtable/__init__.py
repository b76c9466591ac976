"""voxtable: a PySpark engine for preparing and evaluating speech corpora as DataFrames."""
