"""Where entries and operations come from and go to."""
