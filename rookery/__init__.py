"""Analytics over board-game positions and vectors, on PySpark."""
