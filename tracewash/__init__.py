"""Privacy-metadata forensics and scrubbing on Spark DataFrames."""
