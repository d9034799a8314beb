"""Set-based analytics over a media catalogue and its append-only processing log."""

__version__ = "0.1.0"
