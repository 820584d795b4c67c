"""Directed multigraphs as node and edge frames."""

from loomgrid.graph.mesh import MeshGraph

__all__ = ["MeshGraph"]
