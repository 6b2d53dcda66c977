"""Readers and writers of variant files, and views that give benchmark tables a variant shape."""
