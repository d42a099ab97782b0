"""Row producers: source text to claims."""
