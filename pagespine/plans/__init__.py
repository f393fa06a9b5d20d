"""Record contracts, and the plans that turn pages into their rows."""
