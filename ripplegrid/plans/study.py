"""The stability study: fits in equal chunks, link frequencies, and the graph of the stable links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import graph
from ..operators.panel import Panel
from ..operators.stability import active_magnitude, chunk_coefficients, chunk_frequency


@dataclass
class Study:
    coefs: DataFrame
    freq: DataFrame
    edges: DataFrame
    nodes: DataFrame
    density: DataFrame


def link_graph(panel: Panel, *, lag: int = 1, q: float = 0.9, n_chunks: int = 30, least: float = graph.LEAST, sectors: DataFrame | None = None) -> Study:
    """Chunk fits, the share of chunks that have each link, and the graph of the links above `least`."""
    coefs = chunk_coefficients(panel, lag, q, n_chunks)
    freq = chunk_frequency(coefs)
    edges = graph.edges(freq, active_magnitude(coefs), least)
    return Study(coefs, freq, edges, graph.nodes(edges, freq, sectors), graph.density(edges))
