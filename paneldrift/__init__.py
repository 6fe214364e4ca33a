"""Change analytics over long panels (plot x scenario x species x year) on PySpark."""

__version__ = "0.1.0"
