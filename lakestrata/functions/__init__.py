"""Scalar functions: paths and identities, as Python values and as Columns."""
