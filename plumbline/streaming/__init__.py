"""The run-quality feed as a stream; an addition of this library."""
