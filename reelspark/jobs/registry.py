"""Modules of registered queries."""

from reelspark.jobs import catalog_queries, damage_queries, disc_queries, file_queries, frame_queries, range_queries, stream_queries

MODULES = [range_queries, frame_queries, catalog_queries, damage_queries, file_queries, disc_queries, stream_queries]
