"""Queue processing and change detection as streams."""
