"""All registered queries of the engine."""

from plotloom.plans import basics, catalogue, evaluation, media, stored, stories, views, vqa  # noqa: F401
from plotloom.plans.registry import QUERIES, SQL  # noqa: F401
