"""Part of stilus."""
