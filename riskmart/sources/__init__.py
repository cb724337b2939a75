from riskmart.sources.star import (
    TABLES, Star, conform, read_clustered, read_star, write_clustered, write_star)

__all__ = ["TABLES", "Star", "conform", "read_clustered", "read_star", "write_clustered", "write_star"]
