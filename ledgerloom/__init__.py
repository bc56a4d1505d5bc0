"""Working-capital and supply-chain analytics as lazily evaluated Spark plans."""

from ledgerloom.tables import MissingTable, Tables

__all__ = ["MissingTable", "Tables"]
