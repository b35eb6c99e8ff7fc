"""Sources and sinks of images, masks and results."""
