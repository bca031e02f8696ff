"""Functions that build column expressions."""
