"""All registered queries and the SQL that must give the same rows."""

from . import colors, editing, grids, images, local, records, search, workspace  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
