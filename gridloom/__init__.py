"""Grid, region, curve, rule and change-log operators on Spark DataFrames."""
