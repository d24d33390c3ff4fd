"""Readers of usage logs, stores and configuration."""
