"""arrowlake: diagram graphs, detections and tracks as Spark DataFrames."""
