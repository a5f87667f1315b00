"""joinseek: find out how tables can be joined, as Spark DataFrame jobs."""

from joinseek.params import Params
from joinseek.plans.discover import Discovery, discover_joins

__all__ = ["Discovery", "Params", "discover_joins"]
