"""Pixel-table analytics and training-data operators on PySpark."""
