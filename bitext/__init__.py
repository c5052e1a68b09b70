"""bitext: preparing and scoring sentence-aligned parallel text on Spark."""

__version__ = "0.1.0"
