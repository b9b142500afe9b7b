"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  `registry` holds the thin
``opN_<name>`` queries; every operator module keeps a general interface.
"""
