"""Column functions: tensors, linear algebra, pixels, boxes and token arrays as native expressions on array columns."""
