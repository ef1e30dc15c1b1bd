"""featloom: feature engineering and machine-learning data work on Spark DataFrames."""
