"""openweave: analysis of open-ended text answers as composable Spark DataFrame operators."""

__version__ = "0.1.0"
