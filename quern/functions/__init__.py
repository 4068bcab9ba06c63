"""Fixed tables of the C language and column expressions on them."""
