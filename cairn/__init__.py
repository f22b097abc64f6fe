"""Field mapping as Spark jobs: plain functions from DataFrames to DataFrames."""
