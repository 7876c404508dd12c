"""Knowledge-graph recommendation analytics as plain DataFrame functions."""
