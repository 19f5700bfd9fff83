"""Column functions for nucleotide strings and k-mers."""
