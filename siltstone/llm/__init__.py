"""Training-data operators: ten corpus operations built on Spark.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
