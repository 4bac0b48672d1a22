"""Panel analytics for net-asset-value series on Spark DataFrames."""
