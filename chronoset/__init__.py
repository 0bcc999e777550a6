"""Timed-event analytics on Spark: notes, beats, spans, frames and what annotates them."""
