"""Operators for training-corpus pipelines. Nothing outside this subpackage imports it."""
