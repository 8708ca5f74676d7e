"""Training-data operators; nothing else in keepsake imports this subpackage."""
