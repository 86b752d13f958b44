"""Part of the tag-lens engine."""
