"""Table operators: each takes and returns DataFrames, ``df.transform``-friendly."""
