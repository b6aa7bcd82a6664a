"""Time-series similarity analytics as lazy DataFrame plans."""

__version__ = "0.1.0"
