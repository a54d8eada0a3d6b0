"""Part of harrow."""
