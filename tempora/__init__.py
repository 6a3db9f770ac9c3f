"""Time-resolved decoding, encoding and inference on Spark DataFrames."""
