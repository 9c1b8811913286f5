"""Logical plans, the selector language and the pipeline language."""
