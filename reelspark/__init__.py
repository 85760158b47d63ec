"""Keyframe, layout and ordered-sequence analytics on Spark."""
