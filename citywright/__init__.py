"""City-mobility data work as Spark jobs: DataFrames in, DataFrames out."""
