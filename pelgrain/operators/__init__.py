"""Operators on pixel, layer and shape tables: DataFrame in, DataFrame out."""
