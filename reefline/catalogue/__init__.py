"""Every registered query. Importing the package fills the registry."""

from reefline.catalogue import (  # noqa: F401
    abundance,
    camera,
    columns,
    files,
    pictures,
    places,
    suggestions,
    teaching,
    tracking,
)
from reefline.catalogue.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
