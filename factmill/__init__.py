"""factmill: clinical-fact analytics on Spark DataFrames."""
