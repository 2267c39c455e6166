"""tallow: instruction-data selection and scoring on Spark DataFrames."""
