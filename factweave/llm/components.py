"""Connected components, for the text operators."""

from factweave.components import components  # noqa: F401
