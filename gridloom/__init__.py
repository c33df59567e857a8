"""gridloom: a Spark-first analytics engine for planning utility-network connections.

DataFrames in, DataFrames out.  ``functions`` holds column-level geometry,
``operators`` the relational, spatial and graph operators, ``sources`` the
GeoJSON reader and writer, ``plans`` whole pipelines and the registered
queries, ``streaming`` the incremental variants.
"""

__version__ = "0.1.0"
