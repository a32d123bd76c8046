"""kelpline: review and catalogue analytics on Spark DataFrames."""
