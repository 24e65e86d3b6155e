"""adlens: online-advertising analytics as lazy PySpark DataFrame operators.

Every public operator is a pure ``DataFrame -> DataFrame`` function built
from Spark built-ins (joins, aggregates, windows, generators). Nothing runs
until the caller triggers an action.
"""

__version__ = "0.1.0"
