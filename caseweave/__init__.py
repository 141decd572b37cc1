"""caseweave: linked-record analytics as Spark jobs, from DataFrames to DataFrames."""
