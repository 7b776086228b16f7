"""flowspark: order-book and trade-tape analytics as Spark DataFrame plans."""
