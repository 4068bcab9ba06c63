"""Lexing and structure of C source as DataFrame operations."""
