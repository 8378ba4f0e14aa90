"""Land-record reconciliation on Spark DataFrames."""

from landrecon.settings import Settings

__all__ = ["Settings"]
