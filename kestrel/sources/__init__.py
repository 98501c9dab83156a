"""Sources: bounded tables, text files, line streams and replays."""

from kestrel.sources.replay import replay_groups, replay_rows
from kestrel.sources.tables import (
    events_points, embedding_points, ratings_from_orders, read_table, text_point_lines,
    text_rating_lines)
from kestrel.sources.text import read_lines_stream, read_points_csv, read_points_stream, read_ratings

__all__ = [
    "events_points", "embedding_points", "ratings_from_orders", "read_table",
    "text_point_lines", "text_rating_lines", "read_lines_stream", "read_points_csv",
    "read_points_stream", "read_ratings", "replay_groups", "replay_rows",
]
