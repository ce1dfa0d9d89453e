"""Streams of hourly facts."""
