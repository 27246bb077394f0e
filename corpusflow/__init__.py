"""corpusflow: labelled-text curation, splitting, scoring statistics and telemetry
analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function over the
public PySpark API; compose them with ``df.transform(...)``.
"""

__version__ = "0.1.0"
