"""quillstone: graph, scheduling, ordering and measurement analytics on Spark."""
