"""User-level operators: composite DataFrame -> DataFrame functions."""
