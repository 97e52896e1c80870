"""Readers of annotation, prediction and diagram-source files, and the sinks that write them."""
