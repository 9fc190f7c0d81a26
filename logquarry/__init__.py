"""Windows event-log analytics on Spark: sources, decoders, renderers and column functions."""

__version__ = "0.1.0"
