"""sondeo: survey analytics expressed as Spark DataFrame / SQL plans.

Sub-packages
------------
sources     readers for survey exports and the driver tables, sinks
functions   Column-expression builders (recodes, text, dates, selectors)
operators   DataFrame -> DataFrame analytics (frequencies, items, scoring, linkage, ...)
models      iterative estimators whose heavy lifting is Spark aggregation (GLM, GLMM, IRT)
plans       end-to-end analyses composed from operators; the registered query catalog
streaming   incremental ingestion of survey waves with Structured Streaming
"""

__version__ = "0.1.0"
