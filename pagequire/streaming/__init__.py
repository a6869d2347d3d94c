"""streaming of the page-layout engine."""
