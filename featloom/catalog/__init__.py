"""Named queries over the test tables, each with its SQL twin where SQL can say it."""

from featloom.catalog import (  # noqa: F401
    batch, changes, definitions, events, models, quality, registry, serving, store, streams,
)
from featloom.catalog.base import ORACLES, QUERIES  # noqa: F401
