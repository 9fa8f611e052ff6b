"""Record linkage by exhaustive nearest-neighbour matching, as Spark jobs."""
