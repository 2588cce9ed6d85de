"""Set-based operators: every function takes and returns DataFrames."""
