"""quire: document analytics on Spark DataFrames.

Every public operator is a function ``(DataFrame, ...parameters) -> DataFrame``.
Subpackages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (lines, columns, headings, sections, entities,
reports, learning), ``plans`` (whole flows and their queries), ``streaming``.
"""

__version__ = "0.1.0"
