"""Cross-sectional panel analytics and data preparation on Spark DataFrames."""
