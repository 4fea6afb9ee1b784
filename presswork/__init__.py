"""presswork: newsroom analytics as Spark DataFrame plans.

Every operator is a function ``(Tables, Period, Filters, Settings, ...) ->
DataFrame``. Nothing is collected; the caller decides on the action.
"""

from presswork.params import Filters, Period, Settings

__all__ = ["Filters", "Period", "Settings"]
