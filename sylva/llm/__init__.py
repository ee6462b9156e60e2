"""Operators of a training-data pipeline: classifiers, joins, filters, encoders and sharding over ``documents``."""
