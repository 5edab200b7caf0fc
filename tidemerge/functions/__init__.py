"""Part of tidemerge."""
