"""Operators of a training-data pipeline: search, near duplicates, language, sketches, packing, secrets,
repeated passages, page text, quality, mixing, conversation repair, manifests and byte-level encoding. Nothing outside this subpackage imports it."""
