"""The model graph: named DataFrames built from sources and from each other."""
