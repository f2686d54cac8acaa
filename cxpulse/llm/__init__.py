"""Training-data operators (near-dedup, filtering, scanning, mixing, packing) on Spark DataFrames."""
