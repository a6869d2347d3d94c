"""plans of the page-layout engine."""
