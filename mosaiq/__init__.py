"""mosaiq: layered, tiled, ordered data processing on PySpark."""
