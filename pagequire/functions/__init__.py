"""functions of the page-layout engine."""
