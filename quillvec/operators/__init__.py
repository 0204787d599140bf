"""Search, graph, quantization and maintenance operators over vector tables."""
