"""pelgrain: a PySpark-native engine for raster analysis and vectorisation."""
