"""Graph connectivity analytics and training-data operators on PySpark."""
