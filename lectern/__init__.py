"""lectern: catalog retrieval, grounding and evaluation as Spark jobs.

Everything is a function from DataFrames to DataFrames; Catalyst plans the work.
"""

__version__ = "0.1.0"
