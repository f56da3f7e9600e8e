"""Inputs: line protocol, tick files, notifications, checkpoints."""
