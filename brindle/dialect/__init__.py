"""The SQL dialect: text to tokens to a tree to Spark SQL."""
