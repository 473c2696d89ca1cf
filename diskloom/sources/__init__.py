"""Images and host files in, files and images out."""
