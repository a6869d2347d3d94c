"""operators of the page-layout engine."""
