"""All registered queries of the engine itself."""

from weftline.plans import more as _more  # noqa: F401  registers its queries
from weftline.plans.registry import QUERIES as QUERIES
