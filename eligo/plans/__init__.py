"""Views that map the driver's tables onto the library's tables."""
