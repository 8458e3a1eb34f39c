"""cartlift: retail-loyalty analytics and campaign incrementality on Spark.

Everything row-level is a DataFrame job; the driver only ever sees few-row
readouts, k-by-k matrices and bounded boundary samples.
"""

__version__ = "0.1.0"
