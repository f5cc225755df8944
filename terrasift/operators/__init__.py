"""Table jobs: each takes and returns DataFrames."""
