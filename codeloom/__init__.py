"""codeloom: code-intelligence analytics as composable PySpark DataFrames."""
