"""Sources and sinks."""

from leafwright.sources.tables import load

__all__ = ["load"]
