"""Scalar functions over Columns: no Python runs per row."""

from quarrylake.functions.links import *  # noqa: F403
from quarrylake.functions.text import *  # noqa: F403
from quarrylake.functions.trust import *  # noqa: F403
