"""The immutable state that mutations go from and to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillgraph.operators.integrity import Catalog


@dataclass
class Snapshot:
    nodes: DataFrame
    edges: DataFrame
    history: DataFrame
    catalog: Catalog = field(default_factory=Catalog)
    now: int = 0
