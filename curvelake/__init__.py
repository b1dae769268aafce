"""curvelake: preparing, checking and querying vector-geometry tables with PySpark."""

__version__ = "0.1.0"
