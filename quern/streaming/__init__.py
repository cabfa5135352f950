"""Views over streams of progress events."""
