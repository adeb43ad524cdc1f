"""Connected components, as the main library has them."""

from memlens.operators.components import components  # noqa: F401
