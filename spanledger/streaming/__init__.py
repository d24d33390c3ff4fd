"""Structured Streaming: tailing, stateful supersede, alerts and supervision."""
