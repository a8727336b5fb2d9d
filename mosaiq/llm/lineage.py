"""Cutting lineage in the shared checkpoint folder, as the rest of the library does."""

from mosaiq.checkpoints import cut

__all__ = ["cut"]
