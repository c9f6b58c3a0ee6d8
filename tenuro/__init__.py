"""Customer-retention analytics on Spark DataFrames."""

from tenuro.operators import *  # noqa: F401,F403
from tenuro.operators import __all__ as _operators
from tenuro.plans import *  # noqa: F401,F403
from tenuro.plans import __all__ as _plans
from tenuro.sources import *  # noqa: F401,F403
from tenuro.sources import __all__ as _sources

__all__ = sorted([*_operators, *_plans, *_sources])
