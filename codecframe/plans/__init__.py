"""codecframe: query plans over the driver tables."""
