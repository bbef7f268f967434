"""Writers: articles and graphs to the formats other programs read."""
