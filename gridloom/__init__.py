"""gridloom: spatial screening analytics and corpus operators, declared as Spark DataFrames."""
