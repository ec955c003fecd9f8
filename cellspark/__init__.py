"""Single-cell image analytics and corpus preparation as Spark DataFrame operators."""
