"""tabloom: set-oriented analytics over collections of small tables, on Spark.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; nothing is executed until the caller asks for a result, except where a
docstring says that a size is measured first.
"""
