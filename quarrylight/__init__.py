"""Quarrylight: repository analytics and data-processing operators as lazy Spark plans."""
