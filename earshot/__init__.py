"""earshot: listening-survey harmonisation and text-corpus operators on Spark DataFrames."""
