"""Column functions on texts and addresses."""
