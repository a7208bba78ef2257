"""Fixed values and tables of the detectors."""
