"""Part of wattloom."""
