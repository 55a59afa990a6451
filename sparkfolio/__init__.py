"""sparkfolio: evidence-grounded document analytics, expressed as Spark DataFrames."""
