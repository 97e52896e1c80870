"""Stateful operators over ordered frame streams."""
