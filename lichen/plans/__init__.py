"""Whole queries over the star-schema stand-ins, each with its SQL."""

from lichen.plans.catalog import CATALOG

from lichen.plans import catalog_grids, catalog_layers, catalog_more, catalog_names, catalog_texts  # isort: skip  # each adds its own to CATALOG

__all__ = ["CATALOG", "catalog_grids", "catalog_layers", "catalog_more", "catalog_names", "catalog_texts"]
