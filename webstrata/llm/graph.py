"""Connected components, as the core library computes them."""

from webstrata.operators.components import components

__all__ = ["components"]
