"""All registered queries of the flood library."""

from floodspark.plans import documents, facts, flood, impact, other, surrogate, terrain, water  # noqa: F401
from floodspark.plans.registry import QUERIES, SQL  # noqa: F401
