"""Document analytics on Spark: declarative DataFrame operators, Catalyst first."""

__version__ = "0.1.0"
