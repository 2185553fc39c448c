"""riskframe: vulnerability-record ETL, feature engineering and evaluation as Spark DataFrame functions."""
