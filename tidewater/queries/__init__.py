"""Every query with its oracle; importing the modules registers them."""
