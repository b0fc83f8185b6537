"""Functions of the process-text alignment engine."""
