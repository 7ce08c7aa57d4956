"""The core's queries by area; importing this registers them all."""

from quillon.queries import evaluation, references, retrieval, routing, store, text  # noqa: F401
from quillon.queries.registry import REGISTRY  # noqa: F401
