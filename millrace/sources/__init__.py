"""Tables and request logs to read, results to write and render."""
