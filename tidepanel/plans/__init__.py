"""Named factor sets, the factor catalog, and whole jobs put together from the operators."""
