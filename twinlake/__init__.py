"""twinlake: twin-experiment data assimilation as Spark jobs over long tables."""

__version__ = "0.1.0"
