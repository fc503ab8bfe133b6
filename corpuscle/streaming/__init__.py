"""Streams: fact tables that follow a folder, windowed counts."""
