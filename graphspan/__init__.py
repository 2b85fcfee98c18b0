"""Analytics over graph-shaped program data and ranked predictions, on PySpark."""
