"""Readers and sinks. All readers take explicit schemas or column lists."""
