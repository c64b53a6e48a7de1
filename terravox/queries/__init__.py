"""Queries over the test tables, with equivalent SQL."""

from __future__ import annotations

from . import arrays, files, spatial, tensors

QUERIES = arrays.QUERIES | spatial.QUERIES | tensors.QUERIES | files.QUERIES
SQL = arrays.SQL | spatial.SQL | tensors.SQL | files.SQL
flagship = spatial.voxel_downsample
