"""ledgerline: personnel / cost planning analytics as Spark DataFrame jobs.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
builds a lazy plan; nothing runs until an action (``write``, ``count``,
``collect``) is called by the caller.
"""

__version__ = "0.1.0"
