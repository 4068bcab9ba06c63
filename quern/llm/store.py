"""Intermediate tables in the folder that driver and executors share."""

from ..sources.tables import dropped, released_shuffles, shared_dir, written

__all__ = ["dropped", "released_shuffles", "shared_dir", "written"]
