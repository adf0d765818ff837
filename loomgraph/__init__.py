"""loomgraph: a PySpark-native engine for code graphs, findings and source corpora."""
