"""Part of quirefold."""
