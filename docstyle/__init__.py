"""docstyle: document stylometrics and corpus preparation on PySpark DataFrames."""
