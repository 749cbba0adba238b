"""sleuthframe: investigation analytics written for Spark DataFrames."""
