"""Building blocks: star joins, the load, dimension upkeep, data quality."""
