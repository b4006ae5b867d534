"""opsloom: operational analytics over change history, as plain Spark DataFrames."""
