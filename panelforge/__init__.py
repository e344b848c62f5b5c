"""panelforge: cross-sectional factor research and corpus preparation as Spark jobs."""
