"""Writers for features, aggregates, errors and training sets."""
