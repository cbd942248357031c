"""Frame-in, frame-out operators over pages, posts and session events."""
