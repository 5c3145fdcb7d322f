"""Reference-integrity analytics on Spark: claims checked against facts as declarative plans."""

__version__ = "0.1.0"
