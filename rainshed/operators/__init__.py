"""DataFrame operators: selection, time picks, geometry, combination, reduction and running totals."""
