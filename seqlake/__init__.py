"""seqlake: sequence-model data preparation and evaluation as Spark jobs."""

__version__ = "0.1.0"
