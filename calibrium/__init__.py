"""calibrium: evaluation of probabilistic decision models as Spark DataFrame plans."""

__version__ = "0.1.0"
