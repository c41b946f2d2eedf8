"""All queries of this package, with the SQL that checks them."""

from . import cards, intake, layout, library, more, papers, taxonomy, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cards", "intake", "layout", "library", "more", "papers", "taxonomy", "text"]
