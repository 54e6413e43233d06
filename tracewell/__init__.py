"""Security-event investigation on PySpark DataFrames.

Every analysis is a function from DataFrames to DataFrames: events in, links,
timelines, techniques, risk factors, graphs or case rows out.  Nothing loops
over events on the driver; an analysis that is "per incident" takes the name of
the grouping column and aggregates on it.
"""

__version__ = "0.1.0"
