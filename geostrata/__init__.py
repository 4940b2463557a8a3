"""Spark-native analytics for point clouds, rasters, vector features and site catalogues."""
