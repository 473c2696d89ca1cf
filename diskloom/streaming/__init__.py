"""Images that arrive in a drop folder."""
