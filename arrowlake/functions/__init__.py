"""Column functions: text normalisation, similarity, boxes and transcript parsing. Built-ins only."""
