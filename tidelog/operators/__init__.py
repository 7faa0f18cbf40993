"""Pure transformations from DataFrames to DataFrames."""
