"""sources of the page-layout engine."""
