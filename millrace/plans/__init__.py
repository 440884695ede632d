"""Registered queries of the curation and evaluation operators."""

from . import registry, scenes, audit, files  # noqa: E402, F401, I001  in this order: queries are registered on import
