"""All registered queries."""

from . import artifacts, documents, scoring, snapshots, statistics, worktrees  # noqa: F401
from .registry import PLANS, TWINS  # noqa: F401
