"""End-to-end jobs: each a function of DataFrames and arguments."""
