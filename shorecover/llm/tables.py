"""Written tables in the shared folder, to cut lineage and to compute a table once."""

from ..session import cut

__all__ = ["cut"]
