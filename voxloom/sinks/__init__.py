"""Writers of maps, layers and results."""
