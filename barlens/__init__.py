"""barlens: daily market bar analytics as Spark DataFrame functions.

Every public function takes and returns a ``pyspark.sql.DataFrame``; nothing is
collected to the driver. See README.md for the layout.
"""

__version__ = "0.1.0"
