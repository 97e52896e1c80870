"""DataFrame operators: scoring, graphs, boxes, tracks, repair and data-set assembly."""
