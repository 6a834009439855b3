from lamina.sources.read import Source, literal_rows, read_seed, read_source
from lamina.sources.table import Snapshot, Table

__all__ = ["Snapshot", "Source", "Table", "literal_rows", "read_seed", "read_source"]
